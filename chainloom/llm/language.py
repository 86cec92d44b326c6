"""Language of each article and of each passage in another language, with a confidence.

Evidence is fused by Bayes' rule. The likelihood of a sentence in each language
comes from character n-grams of its words, trained on labelled lines and on a
bounded sample of labelled articles. Each sentence is weighed with a prior for
its article: the languages declared for the articles of its venue, smoothed
towards those of its source, and these towards those of all articles (counted
over the whole table); the declared label, the language the markup declares and
the suffix of the main file's name each multiply it. A block's language is the
one of most of its prose, an article's the one of most prose of all blocks, both
measured in letters shared out by the posteriors of the sentences; in an
article's the prior itself counts as much as one word.

Scan tasks reduce each article to the block, letters and log-likelihoods of its
sentences, before the priors are joined. No text is shuffled.

Defined results: articles without prose (null, empty, markup only) get no
language; a label that is null, blank or names none or several languages is no
evidence; ties go to the first language by code; repeated articles are judged
one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import durable
from .mixing import source_key
from .prose import blocks

# Three-letter codes and English names of the languages that occur.
NAMES = {
    "de": ("deu", "ger", "german"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish", "castilian"),
    "fr": ("fra", "fre", "french"),
    "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch", "flemish"),
    "pl": ("pol", "polish"),
    "pt": ("por", "portuguese"),
    "ru": ("rus", "russian"),
    "uk": ("ukr", "ukrainian"),
}
#: Bound of the training sample: labelled lines and labelled articles of each language.
LINES_PER_LANGUAGE, ARTICLES_PER_LANGUAGE = 500, 60
#: One in so many sentences of the sample is held out to find the temperature, and told by pieces of so many words.
HELD_OUT = 4
PIECE = 2
#: Temperatures tried: parts of the log-likelihoods that count.
TEMPERATURES = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0)
#: Times the model is fitted again with the sentences that agree.
TRAINING_ROUNDS = 2
#: Weight, in articles, of the wider level in a prior.
SMOOTHING = 20.0
#: Probability that a declared language is the true one.
LABEL_TRUST, MARKUP_TRUST, SUFFIX_TRUST = 0.9, 0.9, 0.6
#: Letters that the prior of an article counts for beside its prose.
PRIOR_LETTERS = 5
#: Words whose vectors a worker keeps.
MAX_WORDS = 300_000
#: Priors that are sent to all tasks. Of more hosts than this the priors are joined by a shuffle, but those of the hosts
#: that hold more than one in ``HOT_PARTS`` articles (at most as many) are still sent, so that no host's articles gather.
SENT_HOSTS, HOT_PARTS = 50_000, 500

_WORD = r"[^\W\d_]+(?:['’][^\W\d_]+)*"
_PIECES = re.compile(rf"{_WORD}|[.!?\"“”„«»\0]|''|``")
_BABEL = re.compile(r"\\usepackage\[([^\]]*)\]\{(?:babel|polyglossia)\}|\\(?:selectlanguage|setmainlanguage)\{([^}]*)\}")


def label_language(c: Column) -> Column:
    """Two-letter code of the one language a label names; null if it names none, several or one that is not in ``NAMES``."""
    known = F.create_map(*(F.lit(x) for code, names in NAMES.items() for name in (code, *names) for x in (name, code)))
    low = F.lower(F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    code = F.regexp_extract(low, r"^([a-z]{2,3})([-_][a-z0-9]+)*$", 1)
    words = F.array_distinct(F.filter(F.transform(F.split(low, r"[^\p{L}]+"), lambda w: F.when(F.length(w) > 3, F.try_element_at(known, w))), lambda x: x.isNotNull()))
    return F.when(code != "", F.try_element_at(known, code)).when(F.size(words) == 1, words[0])


ORDERS = (1, 2, 3, 4)
#: Count, in n-grams of a language of median size, that an n-gram must exceed to say much.
SMOOTH = 0.3


def _grams(word: str, order: int) -> list[str]:
    w = word if order == 1 else f" {word} "
    return [w[i : i + order] for i in range(len(w) - order + 1)]


class Model:
    """Naive Bayes over character n-grams: ``vector`` gives a word's log-likelihood in each language."""

    def __init__(self, langs: list[str], table: dict[str, np.ndarray]) -> None:
        self.langs, self.table, self.zero = langs, table, np.zeros(len(langs))

    def vector(self, word: str) -> np.ndarray:
        out = self.zero.copy()
        for order in ORDERS:
            for g in _grams(word, order):
                row = self.table.get(g)
                if row is not None:
                    out += row
        return out


class Corpus:
    """Sentences whose words and n-grams are numbered once for all fits of a model."""

    def __init__(self, sentences: list[list[str]], langs: list[str]) -> None:
        self.langs = langs
        words: dict[str, int] = {}
        self.word = np.array([words.setdefault(w, len(words)) for s in sentences for w in s], dtype=np.int64)
        sizes = np.array([len(s) for s in sentences], dtype=np.int64)
        self.start, self.sentence = np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(sentences)), sizes)
        self.grams: dict[str, int] = {}
        own = [[self.grams.setdefault(g, len(self.grams)) for order in ORDERS for g in _grams(w, order)] for w in words]
        self.gram = np.array([g for x in own for g in x], dtype=np.int64)
        n = np.array([len(x) for x in own], dtype=np.int64)
        self.gram_start, self.gram_word = np.r_[0, np.cumsum(n)[:-1]], np.repeat(np.arange(len(words)), n)
        self.order = np.array([len(g) for g in self.grams])
        self.n_words = len(words)

    def fit(self, lang: np.ndarray, temperature: float = 1.0) -> np.ndarray:
        """Log-likelihoods of each n-gram; ``lang`` numbers the language of each sentence, -1 for those left out."""
        used = lang[self.sentence] >= 0
        table = np.zeros((len(self.grams), len(self.langs)))
        for k in range(len(self.langs)):
            times = np.bincount(self.word[used & (lang[self.sentence] == k)], minlength=self.n_words)
            table[:, k] = np.bincount(self.gram, weights=times[self.gram_word], minlength=len(self.grams))
        for order in ORDERS:
            at = self.order == order
            total = table[at].sum(axis=0) + 1e-9
            # shares, not counts: a language with more training text isn't likelier; an n-gram that nobody has seen says nothing
            table[at] = np.log1p(table[at] / total / (SMOOTH / np.median(total)))
        return table * (temperature / len(ORDERS))

    def words(self, table: np.ndarray) -> np.ndarray:
        """Log-likelihoods of the words in the order they come in."""
        return np.add.reduceat(table[self.gram], self.gram_start)[self.word]

    def scores(self, table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.words(table), self.start)

    def model(self, table: np.ndarray) -> Model:
        return Model(self.langs, {g: row for g, row in zip(self.grams, table) if row.any()})


class Scorer:
    """Sentences of many articles at once, with the vectors of the words met so far."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        # the first places are the ends of an article, a block and a sentence
        self.ids = {"\1": 0, "\0": 1} | {x: 2 for x in (".", "!", "?", '"', "“", "”", "„", "«", "»", "''", "``")}
        self.vectors, self.letters = [self.model.zero] * 3, [0] * 3
        self.matrix = np.zeros((0, len(self.model.langs)))

    def _number(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        get = ids.get
        out = [get(w, -1) for w in words]
        if -1 in out:
            for at, n in enumerate(out):
                if n < 0:
                    w = words[at]
                    n = get(w)
                    if n is None:
                        n = ids[w] = len(self.vectors)
                        self.vectors.append(self.model.vector(w))
                        self.letters.append(len(w))
                    out[at] = n
        return np.array(out, dtype=np.int64)

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Article, block, letters and log-likelihoods of each sentence of the prose of ``texts``."""
        if len(self.vectors) > MAX_WORDS:
            self._clear()
        words: list[str] = []
        for text in texts:
            words += _PIECES.findall(text.lower())
            words.append("\1")
        ids = self._number(words)
        if len(self.matrix) < len(self.vectors):
            self.matrix, self.sizes = np.array(self.vectors), np.array(self.letters)
        article = np.cumsum(ids == 0) - (ids == 0)
        ends = np.cumsum(ids <= 1)
        starts = np.r_[0, np.cumsum(np.bincount(article, weights=ids <= 1, minlength=len(texts)).astype(np.int64))[:-1]]
        block = ends - starts[article]
        word = ids > 2
        part = np.cumsum(~word)[word]
        if not len(part):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, np.zeros((0, len(self.model.langs)))
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        return article[word][first], block[word][first], np.add.reduceat(self.sizes[ids[word]], first), np.add.reduceat(self.matrix[ids[word]], first)


def posterior(loglik: np.ndarray) -> np.ndarray:
    e = np.exp(loglik - loglik.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _first_of_each(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The ``n`` rows of each ``code`` that come first; each task keeps no more than so many of its own before they meet."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy(*order))).filter(F.col("n") <= n).drop("n")


def _temperature(corpus: Corpus, lang: np.ndarray) -> float:
    """The temperature at which a model of three quarters of the sentences foretells the language of short pieces of the others best.

    N-grams overlap and neighbouring words depend on each other, so that sums of their log-likelihoods claim more than they know.
    Whole sentences are nearly always told right, whatever the temperature; pieces of ``PIECE`` words are not.
    """
    held = (lang >= 0) & (np.arange(len(lang)) % HELD_OUT == 0)
    words = corpus.words(corpus.fit(np.where(held, -1, lang)))
    mine = held[corpus.sentence]
    place = np.arange(len(corpus.word)) - corpus.start[corpus.sentence]
    words, truth, first = words[mine], lang[corpus.sentence[mine]], np.flatnonzero(place[mine] % PIECE == 0)
    if not len(first):
        return 1.0
    scores, truth = np.add.reduceat(words, first), truth[first]
    loss = [-np.log(np.maximum(posterior(t * scores)[np.arange(len(truth)), truth], 1e-12)).mean() for t in TEMPERATURES]
    return TEMPERATURES[int(np.argmin(loss))]


def fitted(texts: list[tuple[str, str]], articles: list[tuple[str, list[list[str]]]] = ()) -> Model:
    """Model of labelled texts and of the sentences of labelled articles that agree with their label."""
    langs = sorted({lang for lang, _ in texts})
    at = {lang: k for k, lang in enumerate(langs)}
    lines = [(at[lang], words) for lang, text in texts if (words := re.findall(_WORD, text.lower()))]
    owned = [(n, at[lang], words) for n, (lang, own) in enumerate(articles) if lang in at for words in own]
    corpus = Corpus([w for _, w in lines] + [w for _, _, w in owned], langs)
    said = np.array([k for k, _ in lines] + [k for _, k, _ in owned], dtype=np.int64)
    article = np.array([n for n, _, _ in owned], dtype=np.int64)
    # at first all labels are believed; most are right
    lang = said.copy()
    for _ in range(TRAINING_ROUNDS if owned else 0):
        scores, mine = corpus.scores(corpus.fit(lang))[len(lines) :], said[len(lines) :]
        whole = np.zeros((len(articles), len(langs)))
        np.add.at(whole, article, scores)
        # a wrong label shows in the whole article, a passage in another language in its own sentences
        agree = (whole.argmax(axis=1)[article] == mine) & (scores.argmax(axis=1) == mine)
        lang = said.copy()
        lang[len(lines) :][~agree] = -1
    return corpus.model(corpus.fit(lang, _temperature(corpus, lang)))


def train(lines: DataFrame, documents: DataFrame) -> Model:
    """Fit on the labelled lines and the sentences of sampled articles, then again with those that agree with their label.

    The sample is bounded by ``LINES_PER_LANGUAGE`` and ``ARTICLES_PER_LANGUAGE``: for each language the labelled lines
    and articles with the smallest hash, so that it is the same on every run and no language crowds out another.
    """
    code = label_language(F.col("lang"))
    sample = lines.select(code.alias("code"), "text", F.xxhash64("text").alias("h")).filter("code is not null and text is not null")
    labelled = [(r["code"], r["text"]) for r in _first_of_each(sample, ["h", "text"], LINES_PER_LANGUAGE).collect()]
    if not labelled:
        raise ValueError("no labelled lines to train on")
    ids = documents.select("doc_id", code.alias("code"), F.xxhash64("doc_id").alias("h")).filter(F.col("code").isin(sorted({x for x, _ in labelled})) & F.col("doc_id").isNotNull())
    chosen = [r["doc_id"] for r in _first_of_each(ids, ["h", "doc_id"], ARTICLES_PER_LANGUAGE).collect()]
    # an id may be there more often than once
    found = documents.filter(F.col("doc_id").isin(chosen)).select("doc_id", code.alias("code"), "text", F.xxhash64("doc_id").alias("h")).dropna()
    articles = _first_of_each(found, ["h", "doc_id", "text"], ARTICLES_PER_LANGUAGE).collect()
    own = [(r["code"], [w for s in re.split(r"[.!?\0]|''|``", blocks(r["text"])) if len(w := re.findall(_WORD, s.lower())) >= 3]) for r in sorted(articles, key=lambda r: (r["code"], r["h"], r["doc_id"], r["text"]))]
    return fitted(sorted(labelled), own)


EVIDENCE_SCHEMA = "doc_id {id}, source_key string, venue string, label string, declared string, suffix string, block array<int>, letters array<int>, loglik array<float>"


def _lists(owner: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType, width: int = 1) -> pa.Array:
    """``values`` as one list for each of ``n`` owners; owners ascend."""
    edges = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))] * width
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def _declared(text: str) -> str | None:
    m = _BABEL.search(text) if "babel" in text or "language{" in text or "polyglossia" in text else None
    return (m[1] or m[2]).split(",")[-1].strip() if m else None


def _evidence_of(model: Model):
    """Articles to the block, letters and log-likelihoods of each of their sentences."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, width = Scorer(model), len(model.langs)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                texts = [x or "" for x in rows.column("text").to_pylist()]
                n = len(texts)
                article, block, letters, loglik = scorer.sentences([blocks(x) for x in texts])
                loglik -= loglik.max(axis=1, keepdims=True)  # only differences count; small numbers keep their digits
                fixed = [rows.column(c) for c in ("doc_id", "source_key", "venue", "label")]
                declared = pa.array([_declared(x) for x in texts], pa.string())
                out = [
                    *fixed, declared, rows.column("suffix"),
                    _lists(article, n, block, pa.int32()), _lists(article, n, letters, pa.int32()), _lists(article, n, loglik.astype(np.float32), pa.float32(), width),
                ]
                yield pa.RecordBatch.from_arrays(out, names=[x.split(" ")[0] for x in EVIDENCE_SCHEMA.split(", ")])

    return reduce


def host_priors(documents: DataFrame, langs: list[str]) -> DataFrame:
    """(source_key, venue, n_articles, prior): share of each language among the declared ones of a venue, smoothed level by level."""
    code = label_language(F.col("lang"))
    counts = [F.count_if(F.col("code") == x).cast("double") for x in langs]
    rows = documents.select(_key_of(F.col("source")).alias("source_key"), F.coalesce("venue", F.lit("")).alias("venue"), code.alias("code"))
    venues = rows.groupBy("source_key", "venue").agg(F.array(*counts).alias("seen"), F.count(F.lit(1)).alias("n_articles"))
    added = F.array(*(F.sum(F.col("seen")[k]) for k in range(len(langs))))
    sources = venues.groupBy("source_key").agg(added.alias("of_source"))
    everywhere = sources.agg(F.array(*(F.sum(F.col("of_source")[k]) for k in range(len(langs))))).scalar()

    def smoothed(seen: Column, wider: Column) -> Column:
        total = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(seen, wider, lambda s, w: (s + SMOOTHING * w) / (total + SMOOTHING))

    flat = F.array(*(F.lit(1.0 / len(langs)) for _ in langs))
    joined = venues.join(sources, "source_key").withColumn("everywhere", everywhere).withColumn("top", smoothed(F.col("everywhere"), flat))
    wide = joined.withColumn("middle", smoothed(F.col("of_source"), F.col("top")))
    return wide.select("source_key", "venue", "n_articles", smoothed(F.col("seen"), F.col("middle")).alias("prior"))


def _key_of(c: Column) -> Column:
    return F.coalesce(source_key(c), F.lit(""))


RESULT_SCHEMA = "doc_id {id}, label string, main string, confidence double, block array<int>, lang array<string>, block_confidence array<double>"


def _fused(langs: list[str]):
    """Evidence and priors to the language of each article and of each of its blocks."""
    at = {x: k for k, x in enumerate(langs)}
    known = {name: code for code, names in NAMES.items() for name in (code, *names)}

    def trust(code: str | None, weight: float) -> np.ndarray:
        if code not in at:
            return np.zeros(len(langs))
        out = np.full(len(langs), np.log((1 - weight) / max(1, len(langs) - 1)))
        out[at[code]] = np.log(weight)
        return out

    tables = [{c: trust(c, w) for c in (None, *langs)} for w in (LABEL_TRUST, MARKUP_TRUST, SUFFIX_TRUST)]

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(langs)
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            n = batch.num_rows
            col = {name: batch.column(name) for name in batch.schema.names}
            prior = np.log(np.array([p if p is not None else [1.0 / width] * width for p in col["prior"].to_pylist()]))
            for name, table in zip(("label", "declared", "suffix"), tables):
                prior += np.array([table.get(known.get((x or "").lower()), table[None]) for x in col[name].to_pylist()])

            def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
                values = col[name]
                sizes = np.diff(values.offsets.to_numpy())
                return np.repeat(np.arange(n), sizes), values.flatten().to_numpy(zero_copy_only=False)

            doc, block = flat("block")
            share = posterior(flat("loglik")[1].reshape(-1, width) + prior[doc]) * flat("letters")[1][:, None]
            cell, where = np.unique((doc.astype(np.int64) << 32) | block, return_inverse=True)
            of_block = np.zeros((len(cell), width))
            np.add.at(of_block, where, share)
            owner = cell >> 32
            of_doc = np.zeros((n, width))
            np.add.at(of_doc, owner, of_block)
            some = of_doc.sum(axis=1) > 0
            fused = of_doc + PRIOR_LETTERS * posterior(prior)
            main = [langs[k] if s else None for k, s in zip(fused.argmax(axis=1), some)]
            sure = [float(v) if s else None for v, s in zip(fused.max(axis=1) / fused.sum(axis=1), some)]
            total = of_block.sum(axis=1)
            out = [
                col["doc_id"], col["label"], pa.array(main, pa.string()), pa.array(sure, pa.float64()),
                _lists(owner, n, cell & 0xFFFFFFFF, pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=n))], pa.int32()), pa.array(langs, pa.string()).take(pa.array(of_block.argmax(axis=1)))),
                _lists(owner, n, of_block.max(axis=1) / np.maximum(total, 1e-12), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(out, names=[x.split(" ")[0] for x in RESULT_SCHEMA.split(", ")])

    return fuse


def with_priors(evidence: DataFrame, priors: DataFrame, sent: int = SENT_HOSTS) -> DataFrame:
    """``evidence`` with the ``prior`` of its (source_key, venue); ``priors`` must be durable, for it is counted."""
    host = ["source_key", "venue"]
    if priors.count() <= sent:
        return evidence.join(F.broadcast(priors.select(*host, "prior")), host, "left")
    everything = priors.agg(F.sum("n_articles")).scalar()
    # these hosts hold more than one in HOT_PARTS articles each, so there are fewer than HOT_PARTS
    hot = priors.filter(F.col("n_articles") * HOT_PARTS > everything).select(*host, F.col("prior").alias("hot_prior"))
    marked = evidence.join(F.broadcast(hot), host, "left").withColumn("spread", F.when(F.col("hot_prior").isNotNull(), 1 + F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(HOT_PARTS))).otherwise(F.lit(0)))
    rest = priors.select(*host, F.lit(0).cast("long").alias("spread"), "prior")
    return marked.join(rest, [*host, "spread"], "left").withColumn("prior", F.coalesce("hot_prior", "prior")).drop("hot_prior", "spread")


def identify(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, label, main, confidence, block, lang, block_confidence) of each article.

    ``label`` is the language its label names; ``block`` lists the numbers of the blocks with prose, ``lang`` and
    ``block_confidence`` are parallel to it.
    """
    model = train(lines, documents)
    kind = documents.schema["doc_id"].dataType.simpleString()
    suffix = F.regexp_extract(F.lower("main_file"), r"[._-]([a-z]{2})\.[a-z]+$", 1)
    texts = documents.select("doc_id", _key_of(F.col("source")).alias("source_key"), F.coalesce("venue", F.lit("")).alias("venue"), label_language(F.col("lang")).alias("label"), suffix.alias("suffix"), "text")
    evidence = texts.mapInArrow(_evidence_of(model), EVIDENCE_SCHEMA.format(id=kind))
    priors = durable(host_priors(documents, model.langs))
    joined = with_priors(evidence, priors)
    return joined.mapInArrow(_fused(model.langs), RESULT_SCHEMA.format(id=kind))


def corrections(identified: DataFrame) -> DataFrame:
    """(doc_id, block_no, lang, confidence): block -1 for articles whose label names another or no single language, and each block in another language than its article."""
    article = F.when(F.col("label").isNull() | (F.col("label") != F.col("main")), F.array(F.struct(F.lit(-1).alias("block_no"), F.col("main").alias("lang"), F.col("confidence")))).otherwise(F.array())
    passages = F.filter(F.arrays_zip(F.col("block").alias("block_no"), F.col("lang").alias("lang"), F.col("block_confidence").alias("confidence")), lambda x: x["lang"] != F.col("main"))
    return identified.filter("main is not null").select("doc_id", F.explode(F.concat(article, passages)).alias("x")).select("doc_id", "x.*")
