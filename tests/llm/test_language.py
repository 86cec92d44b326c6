import random

from pyspark.sql import functions as F

from chainloom.llm import language
from chainloom.llm.prose import blocks

LINES = [
    (1, "de", "Das Haus am Ende der Straße gehört meiner Tante und wird bald verkauft."), (2, "de", "Wir haben gestern nicht gewusst, dass der Zug später abfährt."),
    (3, "en", "The house at the end of the street belongs to my aunt and will be sold."), (4, "en", "We did not know yesterday that the train would leave later."),
    (5, "fr", "La maison au bout de la rue appartient à ma tante et sera bientôt vendue."), (6, "fr", "Nous ne savions pas hier que le train partirait plus tard."),
    (7, "ru", "Дом в конце улицы принадлежит моей тёте и скоро будет продан."), (8, "uk", "Будинок наприкінці вулиці належить моїй тітці і скоро буде проданий."),
]
DE, EN, FR = LINES[0][2] + " " + LINES[1][2], LINES[2][2] + " " + LINES[3][2], LINES[4][2] + " " + LINES[5][2]
SCHEMA = "doc_id bigint, text string, lang string, source string, venue string, main_file string, label string, block int, prior string"


def lines(spark):
    return spark.createDataFrame(LINES, "item_id bigint, lang string, text string")


def identify(spark, docs):
    df = spark.createDataFrame([(i, t, lang, s, v, f, "x", 1, "y") for i, t, lang, s, v, f in docs], SCHEMA)
    out = language.identify(df, lines(spark))
    found = sorted((r["doc_id"], r["block_no"], r["lang"]) for r in language.corrections(out).collect())
    return {r["doc_id"]: r for r in out.collect()}, found


def test_labels(spark):
    cases = {"en": "en", "EN": "en", " en-US ": "en", "en_GB": "en", "eng": "en", "English": "en", "ger": "de", "deu": "de", "Brazilian Portuguese": "pt", "mul": None, "und": None, "": None, "??": None, "n/a": None, "zh-Hans": None, "English, German": None, None: None, "Klingon": None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "a string, b string")
    assert {r[0]: r[1] for r in df.select("a", language.label_language(F.col("a"))).collect()} == cases


def test_prose_of_markup():
    text = (
        "\\documentclass{article}\n\n\\newcommand{\\x}{secret}\n\\begin{document}\n\\title{Not \\'{e} this}\n\nOne \\emph{two}~\\cite{k} three $a+\n b$ f\\\"ur Stra{\\ss}e, \\l{}za, gar\\c{c}on.% hidden\n\n"
        "\\section{Head {nested {deep}}}\\label{s}\nBody 50\\% \\& more.\n\n\\begin{equation}\nx\n\n y\\end{equation}\n\nLast \\[ z \\] word.\n  \n\n\\begin{thebibliography}{9}\n\\bibitem{a} Book.\n\n\\end{thebibliography}\n\n\\end{document}\n\nnever"
    )
    parts = [" ".join(p.split()) for p in blocks(text).split("\0")]
    assert parts[2] == "One two~ three für Straße, łza, garçon."
    assert parts[3] == "Body 50% & more."
    assert parts[4] == "" and parts[5] == "" and parts[6] == "Last word."
    assert set(parts[7:]) == {""} and parts[:2] == ["", ""]
    assert blocks("") == "" and blocks("a\\iffalse b\\fi c") == "a  c" and blocks("\\begin{thebibliography}{9} x") == " "


def test_articles_and_passages(spark):
    docs = [
        (1, f"{EN}\n\n{EN}", "en", "s", "v", "a.tex"), (2, f"{EN}\n\n{DE}\n \n% {FR}\n{EN}", "en", "s", "v", "a.tex"), (3, f"{FR}\n\n{FR}", "en", None, None, None), (4, DE, None, "s", None, "a.tex"),
        (5, None, None, None, None, None), (6, "", "en", "s", "v", "a.tex"), (7, "\\section{Only a heading}", "de", "s", "v", "a.tex"), (8, FR, "French", "s", "v", "a.tex"), (8, FR, "French", "s", "v", "a.tex"), (2**61, f"$x$\n\n{EN} ``{DE}'' {EN}", "mul", "S", "v", "a.tex"),
    ]
    out, found = identify(spark, docs)
    assert found == [(2, 1, "de"), (3, -1, "fr"), (4, -1, "de"), (2**61, -1, "en")]
    assert out[5]["main"] is None and out[6]["main"] is None and out[7]["main"] is None
    assert out[1]["confidence"] > 0.9 and out[2]["block"] == [0, 1, 2]


def test_label_and_markup_weigh_on_sentences_that_look_clear(spark):
    """``plus`` is French by its text alone, also at the calibrated temperature; label and markup together say more than that."""
    model = language.fitted([(lang, text) for _, lang, text in LINES])
    assert model.langs[model.vector("plus").argmax()] == "fr" and language.posterior(model.vector("plus")).max() > 0.8
    markup = "\\usepackage[german]{babel}\\begin{document}\n\n"
    out, found = identify(spark, [(1, f"{markup}Plus.", "de", None, None, None), (2, "Plus.", None, None, None, None), (3, f"{markup}{FR}", "de", None, None, None)])
    assert out[1]["main"] == "de" and out[1]["lang"] == ["de"] and found == [(2, -1, "fr"), (3, -1, "fr")]


def test_null_ids_long_text_and_empty_table(spark):
    _, found = identify(spark, [(None, (DE + "\n\n") * 3000, "en", "s", "v", "a.tex")])
    assert found == [(None, -1, "de")]
    assert identify(spark, []) == ({}, [])


def test_priors_are_smoothed_level_by_level(spark):
    docs = [(i, "t", "fr" if i < 30 else "en", "s", "v1" if i < 30 else "v2", "f", "x", 1, "y") for i in range(40)]
    df = spark.createDataFrame(docs, SCHEMA)
    rows = {r["venue"]: r["prior"] for r in language.host_priors(df, ["de", "en", "fr"]).collect()}
    assert abs(sum(rows["v1"]) - 1) < 1e-9 and rows["v1"][2] > rows["v2"][2] > rows["v2"][0] and rows["v2"][1] > rows["v1"][1]


def test_held_out_accuracy(spark):
    """Trained on 100 articles, the labels of others are met wherever they are right (some are wrong on purpose)."""
    small, large = ("/root/testdata/" + x for x in ("sf0.001", "sf0.01"))
    known = spark.read.parquet(f"{small}/documents.parquet")
    model = language.train(spark.read.parquet(f"{small}/lang_sample.parquet"), known)
    seen = {r["doc_id"] for r in known.select("doc_id").collect()}
    label = language.label_language(F.col("lang"))
    docs = [r for r in spark.read.parquet(f"{large}/documents.parquet").select("doc_id", "text", label.alias("code")).filter("code is not null").collect() if r["doc_id"] not in seen]
    scorer, right = language.Scorer(model), 0
    for r in docs:
        right += model.langs[int(scorer.sentences([blocks(r["text"])])[3].sum(axis=0).argmax())] == r["code"]
    assert len(docs) > 500 and right >= 0.9 * len(docs)


def test_no_language_crowds_out_another(spark):
    """More lines of one language than the bound: all languages stay, in any order of codes and texts."""
    many = [(i, "de", f"Das Haus Nummer {i} steht am Ende der langen Straße.") for i in range(3 * language.LINES_PER_LANGUAGE)] + [x for x in LINES if x[1] in ("ru", "uk", "fr")]
    model = language.train(spark.createDataFrame(many, "item_id bigint, lang string, text string"), spark.createDataFrame([], SCHEMA))
    assert model.langs == ["de", "fr", "ru", "uk"]


def test_repeated_ids_are_not_cut(spark):
    docs = [(1, DE, "de", "s", "v", "f", "x", 1, "y")] * 5 + [(i, EN, "en", "s", "v", "f", "x", 1, "y") for i in range(2, 9)]
    assert language.train(lines(spark), spark.createDataFrame(docs, SCHEMA)).langs == ["de", "en", "fr", "ru", "uk"]


def test_host_prior_decides_where_the_text_does_not(spark):
    """An unlabelled word that two languages share takes the language of its venue; without the prior both venues' articles read alike."""
    model = language.fitted([(lang, text) for _, lang, text in LINES])
    docs = [(i, "$x$", "de" if i < 200 else "fr", "s", "a" if i < 200 else "b", None, "x", 1, "y") for i in range(400)]
    priors = language.host_priors(spark.createDataFrame(docs, SCHEMA), model.langs)
    word = next(w for w in ("tante", "est", "des", "plus", "rue", "le", "train") if 0.02 < language.posterior(model.vector(w))[model.langs.index("de")] < 0.98)
    row = [(k, "s", v, None, None, None, [0], [len(word)], [float(x) for x in model.vector(word)]) for k, v in enumerate("ab")]
    evidence = spark.createDataFrame(row, language.EVIDENCE_SCHEMA.format(id="bigint"))

    def mains(p):
        out = language.with_priors(evidence, p).mapInArrow(language._fused(model.langs), language.RESULT_SCHEMA.format(id="bigint"))
        return {r["doc_id"]: r["main"] for r in out.collect()}

    flat = priors.withColumn("prior", F.array(*(F.lit(1.0 / len(model.langs)) for _ in model.langs)))
    assert mains(priors) == {0: "de", 1: "fr"} and len(set(mains(flat).values())) == 1


def test_priors_joined_by_shuffle_are_the_same(spark):
    docs = [(i, "t", "fr" if i % 3 else "en", "s", "hot" if i % 2 else f"v{i}", "f", "x", 1, "y") for i in range(300)]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("source_key", F.lit("s"))
    priors = language.host_priors(df, ["en", "fr"])
    few, many = language.with_priors(df.drop("prior"), priors), language.with_priors(df.drop("prior"), priors, sent=0)
    assert sorted(map(tuple, few.select("doc_id", "prior").collect())) == sorted(map(tuple, many.select("doc_id", "prior").collect()))


def test_temperature_is_below_one_where_pieces_mislead():
    rng = random.Random(5)
    words = {"a": [f"ka{x}n" for x in "aeiou"], "b": [f"ka{x}m" for x in "aeiou"]}
    texts = [(lang, " ".join(rng.choice(words[lang] if rng.random() < 0.7 else words["ab".replace(lang, "")]) for _ in range(6))) for lang in "ab" for _ in range(60)]
    model = language.fitted(texts)
    assert abs(model.vector("kaan") - model.vector("kaam")).max() < 3
