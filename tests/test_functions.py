import random
import unicodedata

from pyspark.sql import functions as F

from citeweave.functions import citekeys, redact
from citeweave.functions import text as T


def one(spark, col, **vals):
    df = spark.createDataFrame([tuple(vals.values())], list(vals))
    return df.select(col.alias("o")).first()["o"]


def test_fold_matches_unicode_rules(spark):
    def want(t):
        t = unicodedata.normalize("NFKC", t).replace("μg", T.MU_GRAM)
        for k, v in T.symbol_table().items():
            t = t.replace(k, v)
        return t.encode("ascii", "ignore").decode()

    rnd = random.Random(5)
    pool = [chr(c) for c in range(32, 127)] + list("éÑüμµgαΩ±²₃™℃½ﬁ①Ａ㎍…“–—‑″′≠") + [chr(c) for c in range(0x300, 0x370)]
    rows = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    rows += ["TNF-α levels in TiO₂ nanotubes", "15 μg/mL", "éa", "≠"]
    out = spark.createDataFrame([(r,) for r in rows], "t string").select("t", T.ascii_fold(F.col("t")).alias("o")).collect()
    assert [r.o for r in out] == [want(r.t) for r in out]
    assert {r.t: r.o for r in out}["TNF-α levels in TiO₂ nanotubes"] == "TNF-alpha levels in TiO2 nanotubes"
    assert {r.t: r.o for r in out}["15 μg/mL"] == "15 mcg/mL"


def test_claims_and_ids(spark):
    t = "IL-6 dropped by half in the group. Short one. Cells were seen to grow @smith2020 again!"
    assert one(spark, T.claims(F.col("t")), t=t) == [
        "IL-6 dropped by half in the group.", "Cells were seen to grow @smith2020 again!"]
    a = one(spark, T.claim_id(F.col("t")), t="A  Claim here")
    assert a == one(spark, T.claim_id(F.col("t")), t="a claim HERE") and len(a) == 16
    assert one(spark, T.citations(F.col("t")), t="x @b-1 and @a @b-1") == ["a", "b-1"]


def test_evidence_and_sources(spark):
    assert one(spark, T.combine_evidence(F.col("a"), F.col("b")), a="short | much longer", b="short | mid one") == \
        "much longer | mid one | short"
    assert one(spark, T.union_sources(F.col("a"), F.col("b")), a="Chunk 3,7,12 | p.pdf", b="Chunk 5,7,12 | p.pdf") == \
        "Chunk 3,5,7,12 | p.pdf"
    assert one(spark, T.source_index(F.col("a")), a="Chunk 4 | p.pdf") == 4
    assert one(spark, T.bare_doi(F.col("a")), a="https://doi.org/10.1/AB ") == "10.1/ab"


def test_cite_keys(spark):
    key = lambda n: one(spark, citekeys.from_filename(F.col("n")), n=n)
    assert key("Avery et al. - 2024 - T cells.pdf") == "@avery2024"
    assert key("some_title_2021.pdf") == "@some2021"
    assert key("12345.pdf").startswith("@ref_")


def test_redaction(spark):
    rows = [("MR#123456 seen",), ("mail a.b@x.org now",), ("SSN 123-45-6789",), ("call 555-123-4567",),
            ("at Mercy Hospital today",), ("plain text stays",), ("10.0.0.1 host",)]
    df = spark.createDataFrame(rows, "t string")
    out = [(r.o, r.n) for r in redact.redact(df, "t", redact.BOUNDARY, "o", "n").collect()]
    assert out == [("[REDACTED-MRN] seen", 1), ("mail [REDACTED-EMAIL] now", 1), ("SSN [REDACTED-SSN]", 1),
                   ("call [REDACTED-PHONE]", 1), ("at [REDACTED-FACILITY] today", 1), ("plain text stays", 0),
                   ("[REDACTED-IP] host", 1)]
    once = spark.createDataFrame([(o,) for o, _ in out], "o string")
    twice = redact.redact(once, "o", redact.BOUNDARY, "p", "m")
    assert redact.redact(df, "t", redact.BOUNDARY, "o", "n").filter("n > 0").count() == 6
    assert all(r.o == r.p for r in twice.select("o", "p").collect())
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("name").alias("label")),
                    F.struct(F.lit(8).alias("start"), F.lit(11).alias("end"), F.lit("loc").alias("label")))
    assert one(spark, redact.mask_spans(F.col("t"), spans), t="Bob saw Ulm.") == "[REDACTED-NAME] saw [REDACTED-LOC]."


def test_overlapping_spans_are_one(spark):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("label")) for a, b, c in (
        (4, 9, "loc"), (0, 5, "name"), (12, 14, "id"))])
    assert one(spark, redact.mask_spans(F.col("t"), spans), t="abcdefghijklmnop") == "[REDACTED-NAME]jkl[REDACTED-ID]op"


def test_custom_rules_need_no_digit(spark):
    rules = redact.custom_rules(["# comment", "", "  ", "Acme Biologics", r"lot \d+"])
    df = spark.createDataFrame([("contact Acme Biologics now",), ("lot 7 of Acme Biologics",), ("nothing",)], "t string")
    got = [tuple(r) for r in redact.redact(df, "t", rules, "clean", "n").select("clean", "n").collect()]
    assert got == [("contact [REDACTED] now", 1), ("[REDACTED] of [REDACTED]", 2), ("nothing", 0)]


def test_json_object(spark):
    cases = {
        '{"a": 1}': '{"a": 1}', 'x ```json\n{"a": 2}\n``` y': '{"a": 2}', 'the answer {"a": {"b": 3}} ends': '{"a": {"b": 3}}',
        '<think>{"no": 1}</think>{"a": 4}': '{"a": 4}', '{"a": ': None, "[1, 2]": None, "none } at { all": None, "": None,
    }
    for answer, want in cases.items():
        assert one(spark, T.json_object(F.col("t")), t=answer) == want


def test_node_labels(spark):
    from citeweave.functions import render

    cases = {"a.pdf::Gene:Interleukin": "Interleukin", "Gene:IL6": "Gene:IL6", "plain": "plain", "a::b": "b", "Type: Long name": "Long name"}
    for node, want in cases.items():
        assert one(spark, render.node_label(F.col("t")), t=node) == want
