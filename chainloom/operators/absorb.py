"""Absorption of truncated structures into longer ones, and the pair relations behind it.

The outcome depends on the order in which structures arrive, so the order is
fixed: annotation samples first, then by manifest order, gene blocks in the order
of their file (by gene where no lines are known), exon count descending
within a block, first line. Only structures whose spans overlap or touch can
meet, so the fold runs per locus. What repeats exactly never decides anything
of its own: repeated structures are merged with partial aggregation before the
fold, follow the outcome of their first arrival, and bring their samples along.

Chains are ascending on both strands; which end is 5' follows from the strand.

Defined results: a structure without strand or exons is not accepted by the
caller; equal arrival orders are ordered by structure text; a locus with one
structure creates it, unless it is a mono-exon of a sample.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.grouped import fold_groups
from .overlap import locus_numbers, overlap_join
from .spans import CountedSpans, Spans

# Fixed values of the rules.
TERMINAL_TOLERANCE = 50
MAX_MISSING_EXONS = 2

DECISIONS = "structure string, decision string, target string, gene_id string, absorbed boolean, absorbed_into string, absorbed_count int, creation int, first_id string, n_transcripts bigint"


@dataclass(frozen=True)
class AbsorbOptions:
    absorb: bool = True
    fuzzy_tolerance: int = 5
    annotated_loci_only: bool = False


@dataclass
class Segment:
    structure: str
    chain: list[tuple[int, int]]
    strand: str
    gene: str
    loose: bool
    creation: int
    absorbed: bool = False
    into: "Segment | None" = None
    swallowed: int = 0

    @property
    def start(self) -> int:
        return self.chain[0][0]

    @cached_property
    def end(self) -> int:
        return max(e for _, e in self.chain)

    @property
    def span(self) -> tuple[int, int, int]:
        return self.start, self.end, self.creation


def _close(a: tuple[int, int], b: tuple[int, int], tolerance: int) -> bool:
    return abs(a[0] - b[0]) <= tolerance and abs(a[1] - b[1]) <= tolerance


def missing_ends(child: list, parent: list, strand: str, tolerance: int) -> tuple[int, int] | None:
    """Exons of ``parent`` that ``child`` lacks at the (5', 3') end, if its exons are a run of the parent's; exact runs before near ones."""
    n, m = len(child), len(parent)
    if n < 2 or n > m:
        return None
    offsets = range(m - n + 1) if strand == "+" else range(m - n, -1, -1)
    for near in (0, tolerance):
        if near == 0 and n == m:
            continue
        for k in offsets:
            if _close(child[0], parent[k], near) and all(_close(c, p, near) for c, p in zip(child, parent[k : k + n])):
                low, high = k, m - n - k
                return (low, high) if strand == "+" else (high, low)
    return None


def relation(child: list, parent: list, strand: str, tolerance: int) -> str | None:
    """fsm, ism5 (lacks 3' exons), ism3 (lacks few 5' exons), degraded (lacks many) or internal; None if unrelated."""
    missing = missing_ends(child, parent, strand, tolerance)
    if missing is None:
        return None
    five, three = missing
    if len(child) == len(parent):
        return "fsm"
    if five == 0:
        return "ism5"
    if three == 0:
        return "ism3" if five <= MAX_MISSING_EXONS else "degraded"
    return "internal"


def is_terminal_variant(a: list, b: list) -> bool:
    """Same introns and inner exons; outer ends within the tolerance."""
    if len(a) != len(b) or len(a) < 2 or a[1:-1] != b[1:-1]:
        return False
    return a[0][1] == b[0][1] and a[-1][0] == b[-1][0] and abs(a[0][0] - b[0][0]) <= TERMINAL_TOLERANCE and abs(a[-1][1] - b[-1][1]) <= TERMINAL_TOLERANCE


def mono_exon_class(exon: tuple[int, int], chains: list[list]) -> str:
    """intron_retention, gene_overlap or intergenic, against multi-exon chains."""
    overlap = False
    for chain in chains:
        for a, b in zip(chain, chain[1:]):
            if exon[0] < a[1] and exon[1] > b[0]:
                return "intron_retention"
        overlap = overlap or any(exon[0] < e and exon[1] > s for s, e in chain)
    return "gene_overlap" if overlap else "intergenic"


#: Two neighbouring exons of a chain: (start, end, start, end).
Edge = tuple[int, int, int, int]


class Edges:
    """Which segments hold an edge, as bits of their slots, so that the edges of a chain are met by a few operations on whole sets."""

    def __init__(self, tolerance: int) -> None:
        self.tolerance, self.width = tolerance, tolerance + 1
        self.cells: dict[tuple[int, int], dict[Edge, int]] = {}

    def _cell(self, e: Edge) -> tuple[int, int]:
        return e[0] // self.width, e[2] // self.width

    def add(self, e: Edge, bit: int) -> None:
        cell = self.cells.setdefault(self._cell(e), {})
        cell[e] = cell.get(e, 0) | bit

    def remove(self, e: Edge, bit: int) -> None:
        at = self._cell(e)
        cell = self.cells[at]
        cell[e] &= ~bit
        if not cell[e]:
            del cell[e]
        if not cell:
            del self.cells[at]

    def near(self, e: Edge) -> int:
        """The segments that hold an edge whose four positions are near those of ``e``."""
        (x, y), (p, q, r, s), t, found = self._cell(e), e, self.tolerance, 0
        for a in (x - 1, x, x + 1):
            for b in (y - 1, y, y + 1):
                if cell := self.cells.get((a, b)):
                    for (u, v, w, z), bits in cell.items():
                        if -t <= u - p <= t and -t <= v - q <= t and -t <= w - r <= t and -t <= z - s <= t:
                            found |= bits
        return found


class Locus:
    """Live structures of one locus in order of arrival, with the indexes that find the few that a new one can relate to.

    An absorbed structure leaves all indexes at once, so that they grow with what is alive. Live structures of several
    exons have a slot each, which is free again when they go.
    """

    def __init__(self, options: AbsorbOptions) -> None:
        self.o, self.made = options, 0
        # by creation number, within each key
        self.by_introns: dict[tuple, dict[int, Segment]] = {}
        self.slots: list[Segment | None] = []
        self.free: list[int] = []
        self.slot_of: dict[int, int] = {}
        # slots by edge, by edge at the n-th place of the chain, and by the number of edges
        self.edges = Edges(options.fuzzy_tolerance)
        self.edges_at: list[Edges] = []
        self.n_edges: list[int] = []
        self.live: dict[int, Segment] = {}
        # spans of all and of annotated segments; exons and introns of multi-exon ones
        self.spans, self.annotated = Spans(), Spans()
        self.exons, self.introns = CountedSpans(), CountedSpans()

    @staticmethod
    def _introns(chain: list) -> tuple:
        return (chain[0][1], *chain[1:-1], chain[-1][0])

    @staticmethod
    def _edges(chain: list) -> list[Edge]:
        return [(*a, *b) for a, b in zip(chain, chain[1:])]

    def _in_slots(self, bits: int) -> dict[int, Segment]:
        """The segments of the slots, by creation number."""
        found = {}
        for k, byte in enumerate(bits.to_bytes((bits.bit_length() + 7) // 8, "little")):
            while byte:
                low = byte & -byte
                s = self.slots[8 * k + low.bit_length() - 1]
                found[s.creation] = s
                byte ^= low
        return found

    def _holders(self, chain: list) -> dict[int, Segment]:
        """Segments that hold all edges of ``chain``, nearly: those of which it can be a run are among them."""
        bits = -1
        for e in self._edges(chain):
            bits &= self.edges.near(e)
            if not bits:
                return {}
        return self._in_slots(bits)

    def _runs(self, chain: list) -> dict[int, Segment]:
        """Segments of several exons that are a run of ``chain``, nearly."""
        edges, found = self._edges(chain), 0
        for k in range(len(edges)):
            bits = -1
            for at, e in zip(range(min(len(edges) - k, len(self.edges_at))), edges[k:]):
                bits &= self.edges_at[at].near(e)
                if not bits:
                    break
                found |= bits & self.n_edges[at]
        return self._in_slots(found)

    def _sorted(self, found: dict[int, Segment], chain: list) -> list[Segment]:
        start, end = chain[0][0], max(e for _, e in chain)
        return sorted((s for s in found.values() if s.start < end and s.end > start), key=lambda s: (s.start, s.end, s.creation))

    def _first(self, spans: Spans, chain: list) -> Segment | None:
        found = spans.overlapping(chain[0][0], max(e for _, e in chain))
        return self.live[found[2]] if found else None

    def _mono_class(self, exon: tuple[int, int]) -> str:
        """As ``mono_exon_class`` against all live multi-exon segments."""
        if self.introns.within(*exon):
            return "intron_retention"
        return "gene_overlap" if self.exons.overlapping(*exon) else "intergenic"

    def arrive(self, structure: str, chain: list, strand: str, gene: str, strict: bool, loose: bool) -> tuple[str, Segment | None, str]:
        """Decision, the segment that takes the structure (if any) and its gene."""
        several = len(chain) > 1
        variants = self._sorted(self.by_introns.get(self._introns(chain), {}), chain) if several and self.o.absorb else []
        for s in variants:
            if is_terminal_variant(chain, s.chain):
                return self._merged(s, loose, "merged_terminal")
        if not several and not strict:
            if not self.o.absorb:
                return "dropped_mono_noabsorb", None, gene
            kind = self._mono_class(chain[0])
            if kind != "intron_retention":
                return f"dropped_mono_{kind}", None, gene
        if several and self.o.absorb:
            best, how = None, None
            for s in self._sorted(self._holders(chain), chain):
                kind = relation(chain, s.chain, strand, self.o.fuzzy_tolerance)
                if kind == "fsm":
                    return self._merged(s, loose, "merged_fuzzy")
                if kind in (None, "ism5"):
                    continue
                if best is None or len(s.chain) > len(best.chain):
                    best, how = s, kind
            if how == "ism3":
                return self._merged(best, loose, "merged_3prime")
            if best is not None and best.loose:
                return f"dropped_{how}", None, gene
        if not strict:
            annotated = self._first(self.annotated, chain)
            donor = annotated or self._first(self.spans, chain)
            gene = donor.gene if donor else gene
            if self.o.annotated_loci_only and annotated is None:
                return "dropped_unannotated_locus", None, gene
        new = Segment(structure, chain, strand, gene, loose, self.made)
        if self.o.absorb:
            self._absorb_older(new)
        self._keep(new)
        return "created", new, gene

    def _keep(self, new: Segment) -> None:
        self.made += 1
        self.live[new.creation] = new
        self.spans.add(new.span)
        if new.loose:
            self.annotated.add(new.span)
        if len(new.chain) > 1:
            self.by_introns.setdefault(self._introns(new.chain), {})[new.creation] = new
            self._take_slot(new)
            for exon in new.chain:
                self.exons.hold(*exon)
            for a, b in zip(new.chain, new.chain[1:]):
                self.introns.hold(a[1], b[0])

    def _take_slot(self, new: Segment) -> None:
        if self.free:
            slot = self.free.pop()
            self.slots[slot] = new
        else:
            slot = len(self.slots)
            self.slots.append(new)
        self.slot_of[new.creation] = slot
        edges, bit = self._edges(new.chain), 1 << slot
        while len(self.edges_at) < len(edges):
            self.edges_at.append(Edges(self.o.fuzzy_tolerance))
            self.n_edges.append(0)
        for at, e in enumerate(edges):
            self.edges.add(e, bit)
            self.edges_at[at].add(e, bit)
        self.n_edges[len(edges) - 1] |= bit

    def _leave_slot(self, old: Segment) -> None:
        slot = self.slot_of.pop(old.creation)
        edges, bit = self._edges(old.chain), 1 << slot
        for at, e in enumerate(edges):
            self.edges_at[at].remove(e, bit)
        for e in set(edges):
            self.edges.remove(e, bit)
        self.n_edges[len(edges) - 1] &= ~bit
        self.slots[slot] = None
        self.free.append(slot)

    def _forget(self, old: Segment, into: Segment | None) -> None:
        old.absorbed, old.into = True, into
        del self.live[old.creation]
        self.spans.remove(old.span)
        if old.loose:
            self.annotated.remove(old.span)
        key = self._introns(old.chain)
        del self.by_introns[key][old.creation]
        if not self.by_introns[key]:
            del self.by_introns[key]
        self._leave_slot(old)
        for exon in old.chain:
            self.exons.release(*exon)
        for a, b in zip(old.chain, old.chain[1:]):
            self.introns.release(a[1], b[0])

    def _merged(self, s: Segment, loose: bool, how: str) -> tuple[str, Segment, str]:
        s.swallowed += 1
        if loose and not s.loose:
            s.loose = True
            self.annotated.add(s.span)
        return how, s, s.gene

    def _absorb_older(self, new: Segment) -> None:
        """Called before ``new`` is kept, so that its flags may still change."""
        if len(new.chain) < 2:
            return
        found = self.by_introns.get(self._introns(new.chain), {}) | self._runs(new.chain)
        new_is_annotation = new.loose
        for old in self._sorted(found, new.chain):
            kind = "fsm" if is_terminal_variant(old.chain, new.chain) else relation(old.chain, new.chain, new.strand, self.o.fuzzy_tolerance)
            if kind in ("fsm", "ism3"):
                new.swallowed += old.swallowed + 1
                new.loose = new.loose or old.loose
                self._forget(old, new)
            elif kind in ("degraded", "internal") and new_is_annotation:
                self._forget(old, None)


def _folder(options: AbsorbOptions):
    def fold(key: tuple, rows: Iterable[tuple]) -> Iterator[tuple]:
        """Rows of (seqid, strand, locus_start, structure, gene_id, is_strict, is_loose, arrival, first_id, n_transcripts) in order of arrival.

        Dropped structures leave at once; the others wait for the end of the locus, as their target may yet be absorbed.
        """
        locus, waiting = Locus(options), []
        for _, strand, _, structure, gene, strict, loose, _, *own_rows in rows:
            chain = [tuple(map(int, x.split("-"))) for x in structure.rsplit(":", 1)[1].split(",")]
            decision, target, gene = locus.arrive(structure, chain, strand, gene, bool(strict), bool(loose))
            if target is None:
                yield structure, decision, None, gene, False, None, 0, -1, *own_rows
            else:
                waiting.append((structure, decision, target, own_rows))
        for structure, decision, target, own_rows in waiting:
            end = target
            while end.into is not None:
                end = end.into
            own = target if decision == "created" else None
            yield (
                structure, decision, None if end.absorbed else end.structure, end.gene,
                bool(own and own.absorbed), own.into.structure if own and own.into else None, own.swallowed if own else 0, own.creation if own else -1, *own_rows,
            )

    return fold


def arrivals(transcripts: DataFrame, samples: DataFrame) -> DataFrame:
    """Distinct structures with the flags of their first arrival: (structure, seqid, strand, start_pos, end_pos, n_exons, gene_id, is_strict, is_loose, arrival, first_id, n_transcripts).

    ``transcripts`` may have ``block_line`` and ``line_no``, the first lines of the gene's block and of the transcript in the
    file of its sample; samples are numbered in the order of their files.
    """
    flags = samples.select("sample_id", "is_annotation", "is_annotation_loose")
    lines = {c: F.lit(0).cast("long") for c in ("block_line", "line_no") if c not in transcripts.columns}
    t = transcripts.withColumns(lines).join(flags, "sample_id", "left").fillna(False, ["is_annotation", "is_annotation_loose"])
    order = F.struct(
        (~F.col("is_annotation_loose")).alias("sampled"), F.coalesce("sample_id", F.lit(2**31 - 1)).alias("file"), F.coalesce("block_line", F.lit(0)).cast("long").alias("block"), F.when(F.coalesce("block_line", F.lit(0)) == 0, F.col("gene_id")).otherwise("").alias("gene"),
        (-F.col("n_exons")).alias("fewer"), F.coalesce("line_no", F.lit(0)).cast("long").alias("line"), "transcript_id",
    )
    first = F.min_by(F.struct("gene_id", "is_annotation", "is_annotation_loose"), order).alias("f")
    rows = t.groupBy("structure", "seqid", "strand", "start_pos", "end_pos", "n_exons").agg(first, F.min(order).alias("arrival"), F.bool_or("is_annotation_loose").alias("is_loose"), F.min("transcript_id").alias("first_id"), F.count(F.lit(1)).alias("n_transcripts"))
    return rows.select("structure", "seqid", "strand", "start_pos", "end_pos", "n_exons", F.col("f.gene_id").alias("gene_id"), F.col("f.is_annotation").alias("is_strict"), "is_loose", "arrival", "first_id", "n_transcripts")


def decide(transcripts: DataFrame, samples: DataFrame, options: AbsorbOptions = AbsorbOptions()) -> DataFrame:
    """One row per distinct structure: decision, the live structure that takes it (``target``, null where it is dropped) and its gene."""
    found = arrivals(transcripts, samples)
    located = locus_numbers(found, ["seqid", "strand"], "start_pos", "end_pos")
    a = F.col("arrival")

    def padded(c: Column, n: int) -> Column:
        return F.lpad(c.cast("string"), n, "0")

    text = F.concat_ws("\t", F.when(a["sampled"], "1").otherwise("0"), padded(a["file"], 11), padded(a["block"], 12), a["gene"], padded(F.lit(10**6) + a["fewer"], 8), padded(a["line"], 12), a["transcript_id"])
    rows = located.select("seqid", "strand", "locus_start", "structure", "gene_id", "is_strict", "is_loose", text.alias("arrival"), "first_id", "n_transcripts")
    return fold_groups(rows, ["seqid", "strand", "locus_start"], ["arrival", "structure"], _folder(options), DECISIONS)


def transcript_decisions(transcripts: DataFrame, decided: DataFrame) -> DataFrame:
    """Every transcript with its decision; all but the first of a created structure are ``merged_exact``."""
    rows = transcripts.select("transcript_id", "structure", "sample_id").join(decided.select("structure", "decision", "target", "gene_id", "first_id"), "structure")
    repeat = (F.col("decision") == "created") & (F.col("transcript_id") != F.col("first_id"))
    return rows.withColumn("decision", F.when(repeat, "merged_exact").otherwise(F.col("decision"))).select("transcript_id", "structure", "sample_id", "decision", "target", "gene_id")


#: What a build counts.
OUTCOMES = ("input", "merged", "absorbed", "discarded", "scaffold")


def counters(decisions: DataFrame, decided: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(outcome, n) for each of ``OUTCOMES``: transcripts that came in, were merged into a structure that was there, or dropped;
    structures that a later one absorbed; transcripts of scaffolds.

    ``before`` has (outcome, n) of what was dropped before the fold; of these, ``discarded`` ones count as input too.
    """
    spark = decisions.sparkSession
    merged, dropped = F.col("decision").startswith("merged"), F.col("decision").startswith("dropped")
    fold = decisions.agg(F.count(F.lit(1)).alias("input"), F.count_if(merged).alias("merged"), F.count_if(dropped).alias("discarded"))
    parts = fold.unpivot([], ["input", "merged", "discarded"], "outcome", "n").unionByName(decided.agg(F.count_if("absorbed").alias("n")).select(F.lit("absorbed").alias("outcome"), "n"))
    if before is not None:
        parts = parts.unionByName(before.select("outcome", "n")).unionByName(before.filter("outcome = 'discarded'").select(F.lit("input").alias("outcome"), "n"))
    every = spark.createDataFrame([(x, 0) for x in OUTCOMES], "outcome string, n bigint")
    return parts.unionByName(every).groupBy("outcome").agg(F.sum("n").alias("n"))


def fold_counters(decided: DataFrame) -> DataFrame:
    """As ``counters``, from the decisions alone: these know how many transcripts have each structure, which are not read again."""
    n, decision = F.col("n_transcripts"), F.col("decision")
    merged = F.when(decision.startswith("merged"), n).when(decision == "created", n - 1).otherwise(0)
    dropped = F.when(decision.startswith("dropped"), n).otherwise(0)
    sums = {"input": F.sum(n), "merged": F.sum(merged), "discarded": F.sum(dropped), "absorbed": F.count_if("absorbed"), "scaffold": F.lit(0)}
    return decided.agg(*(F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in sums.items())).unpivot([], list(sums), "outcome", "n")


def live_segments(decided: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(structure, gene_id, n_transcripts, n_samples) of the structures that are left, with all they took in."""
    kept = transcript_decisions(transcripts, decided).filter("target is not null")
    # all that a live structure took in have its gene
    return kept.groupBy(F.col("target").alias("structure")).agg(F.count(F.lit(1)).alias("n_transcripts"), F.countDistinct("sample_id").alias("n_samples"), F.min("gene_id").alias("gene_id")).select("structure", "gene_id", "n_transcripts", "n_samples")


def tombstones(decided: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(structure, segment_id, seqid, strand, start_pos, end_pos, n_exons, gene_id, absorbed_into): structures that were created and then absorbed;
    ``absorbed_into`` is the live structure that has their transcripts in the end, null where none has."""
    gone = decided.filter("absorbed").select("structure", "gene_id", F.col("target").alias("absorbed_into"))
    shape = transcripts.groupBy("structure", "seqid", "strand", "start_pos", "end_pos", "n_exons").agg(F.min("transcript_id").alias("segment_id"), F.min("chain").alias("chain"))
    return gone.join(shape, "structure")


# --- pair relations ------------------------------------------------------------------------------------------------


def pairs_subsequence(segments: DataFrame) -> DataFrame:
    """(child_id, parent_id, missing_5, missing_3): chains that are a run of a longer one, exactly.

    Joins the child's first exon with equal exons of parents; no other pairs are compared.
    """
    child = segments.filter("n_exons >= 2").select("seqid", "strand", F.col("segment_id").alias("child_id"), F.col("chain").alias("c"), F.col("n_exons").alias("nc"), F.col("chain")[0].alias("x"))
    parent = segments.filter("n_exons >= 3").select("seqid", "strand", F.col("segment_id").alias("parent_id"), F.col("chain").alias("p"), F.col("n_exons").alias("np"), F.posexplode("chain").alias("k", "x"))
    joined = child.join(parent, ["seqid", "strand", "x"]).filter((F.col("nc") < F.col("np")) & (F.col("k") + F.col("nc") <= F.col("np")))
    run = joined.filter(F.slice("p", F.col("k") + 1, F.col("nc").cast("int")) == F.col("c"))
    low, high = F.col("k").cast("long"), F.col("np") - F.col("nc") - F.col("k")
    plus = F.col("strand") == "+"
    return run.select("child_id", "parent_id", F.when(plus, low).otherwise(high).alias("missing_5"), F.when(plus, high).otherwise(low).alias("missing_3"))


def pairs_fuzzy(segments: DataFrame, tolerance: int = 5) -> DataFrame:
    """(child_id, parent_id): chains of at least two exons that are a run of another chain, all boundaries within the tolerance."""
    width = tolerance + 1
    first = F.col("chain")[0]["start_pos"]
    child = segments.filter("n_exons >= 2").select("seqid", "strand", F.col("segment_id").alias("child_id"), F.col("chain").alias("c"), F.col("n_exons").alias("nc"), first.alias("at")).withColumn("cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("at") / width) + d)))
    parent = segments.filter("n_exons >= 2").select("seqid", "strand", F.col("segment_id").alias("parent_id"), F.col("chain").alias("p"), F.col("n_exons").alias("np"), F.posexplode("chain").alias("k", "x")).withColumn("cell", F.floor(F.col("x.start_pos") / width))
    joined = child.join(parent, ["seqid", "strand", "cell"]).filter((F.abs(F.col("at") - F.col("x.start_pos")) <= tolerance) & (F.col("child_id") != F.col("parent_id")) & (F.col("k") + F.col("nc") <= F.col("np")))

    def near(a, b):
        return (F.abs(a["start_pos"] - b["start_pos"]) <= tolerance) & (F.abs(a["end_pos"] - b["end_pos"]) <= tolerance)

    ok = F.forall(F.zip_with("c", F.slice("p", F.col("k") + 1, F.col("nc").cast("int")), near), lambda x: x)
    return joined.filter(ok).select("child_id", "parent_id").distinct()


def pairs_terminal(segments: DataFrame) -> DataFrame:
    """(a_id, b_id), a_id < b_id: terminal variants, by equal introns and a bin of the start."""
    width = TERMINAL_TOLERANCE + 1
    chain = F.col("chain")
    inner = F.array_join(F.transform(F.slice(chain, F.lit(2), F.greatest(F.size(chain) - 2, F.lit(0))), lambda x: F.concat_ws("-", x["start_pos"], x["end_pos"])), ",")
    key = F.concat_ws("|", chain[0]["end_pos"], inner, F.element_at(chain, -1)["start_pos"])
    base = segments.filter("n_exons >= 2").select("seqid", "strand", "n_exons", "segment_id", key.alias("introns"), chain[0]["start_pos"].alias("s"), F.element_at(chain, -1)["end_pos"].alias("e"))
    a = base.select("seqid", "strand", "n_exons", "introns", F.col("segment_id").alias("a_id"), F.col("s").alias("a_s"), F.col("e").alias("a_e"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("s") / width) + d)).alias("cell"))
    b = base.select("seqid", "strand", "n_exons", "introns", F.col("segment_id").alias("b_id"), F.col("s").alias("b_s"), F.col("e").alias("b_e"), F.floor(F.col("s") / width).alias("cell"))
    near = (F.abs(F.col("a_s") - F.col("b_s")) <= TERMINAL_TOLERANCE) & (F.abs(F.col("a_e") - F.col("b_e")) <= TERMINAL_TOLERANCE)
    return a.join(b, ["seqid", "strand", "n_exons", "introns", "cell"]).filter(near & (F.col("a_id") < F.col("b_id"))).select("a_id", "b_id")


def mono_exon_classes(segments: DataFrame) -> DataFrame:
    """(segment_id, mono_class) of single-exon segments against all multi-exon ones of their sequence and strand."""
    mono = segments.filter("n_exons = 1").select("segment_id", "seqid", "strand", F.col("start_pos").alias("m0"), F.col("end_pos").alias("m1"))
    multi = segments.filter("n_exons > 1").select("seqid", "strand", "start_pos", "end_pos", "chain")
    pairs = overlap_join(mono, multi, ["seqid", "strand"], ("m0", "m1"), ("start_pos", "end_pos"))
    chain, n = F.col("chain"), F.size("chain")
    spans = F.exists(F.zip_with(F.slice(chain, F.lit(1), n - 1), F.slice(chain, F.lit(2), n - 1), lambda a, b: (F.col("m0") < a["end_pos"]) & (F.col("m1") > b["start_pos"])), lambda x: x)
    touches = F.exists(chain, lambda x: (F.col("m0") < x["end_pos"]) & (F.col("m1") > x["start_pos"]))
    found = pairs.groupBy("segment_id").agg(F.bool_or(spans).alias("ir"), F.bool_or(touches).alias("ov"))
    kind = F.when(F.col("ir"), "intron_retention").when(F.col("ov"), "gene_overlap").otherwise("intergenic")
    return mono.select("segment_id").join(found, "segment_id", "left").select("segment_id", kind.alias("mono_class"))
