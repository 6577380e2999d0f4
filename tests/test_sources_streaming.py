from pyspark.sql import functions as F

from citeweave.sources import jats, providers, stores
from citeweave.streaming import daemon, tokens

LONG = " ".join(f"word{i}" for i in range(25))
XML = f"""<pmc:article xmlns:pmc="http://x" xmlns:xlink="http://l"><front><article-title>Bone <i>growth</i></article-title>
<contrib contrib-type="author"><surname>Ada</surname><given-names>L</given-names></contrib><abstract>Short abstract.</abstract></front>
<body><p>too short</p><p>{LONG}</p><sec><title>Methods</title><p>{LONG}</p><sec><title>Cells</title><p>{LONG}</p></sec></sec></body>
<fig><label>Fig 1</label><caption>Caption here</caption><graphic xlink:href="f1.png"/></fig>
<ref-list><ref>Short</ref><ref>Smith 2020 a long reference</ref></ref-list></pmc:article>"""


def test_article_xml(spark):
    df = spark.createDataFrame([("PMC1", "10.1/X", XML), ("PMC2", "", "<broken")], "pmcid string, doi string, xml string")
    rows = jats.parse(df).orderBy("chunk_index").collect()
    assert [(r.chunk_type, r.section_title) for r in rows] == [
        ("title", "Article Title"), ("abstract", "Abstract"), ("text", "Body"), ("text", "Methods > Cells"),
        ("text", "Methods"), ("figure", "Figures"), ("reference", "References")]
    assert rows[0].text == "Title: Bone growth" and rows[0].authors == "Ada L" and rows[0].cite_key.startswith("@ref_")
    assert rows[5].text == "[Fig 1] Caption here" and rows[5].figure_image_url == "f1.png"
    assert rows[6].text == "References:\n[1] Smith 2020 a long reference" and rows[0].source == "europe_pmc_xml_PMC1"


def test_paper_search(spark):
    raw = providers.search(spark, ["bone", "skin"], "tests.fake_transport:fetch", limit=5, pagesize="2", mininterval="0")
    papers = providers.archive_papers(raw)
    assert {r.search_term: r.n for r in papers.groupBy("search_term").agg(F.count("*").alias("n")).collect()} == {"bone": 5, "skin": 5}
    first = papers.orderBy("search_term", "rank").first()
    assert first.title == "bone paper 0-0" and first.is_oa and first.first_author == "Ada L" and not first.has_full_text


def test_insert_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v long")
    stores.insert_new(rows, path, "k")
    stores.insert_new(rows.unionByName(spark.createDataFrame([("c", 3)], rows.schema)), path, "k")
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    new = stores.upsert(spark.createDataFrame([("a", 9)], rows.schema), path, str(tmp_path / "t2"), ["k"], ["v"])
    assert {r.k: r.v for r in new.collect()} == {"a": 9, "b": 2, "c": 3}


def test_daemon_resumes_without_duplicates(spark, tmp_path):
    inbox, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.limit(20).write.parquet(inbox)
    daemon.start(spark, inbox, out, ck).awaitTermination(120)
    n = spark.read.parquet(f"{out}/chunks").count()
    docs.limit(20).write.mode("append").parquet(inbox)  # the same papers arrive again
    daemon.start(spark, inbox, out, ck).awaitTermination(120)
    assert n > 0 and spark.read.parquet(f"{out}/chunks").count() == n
    claims = spark.read.parquet(f"{out}/claims")
    assert claims.count() == claims.select("claim_id").distinct().count()


def test_token_monitor(spark, tmp_path):
    folder = str(tmp_path / "tok")
    rows = [("good", i, f"tok{i * 7919 % 9973} ") for i in range(60)] + [("bad", i, "energy ") for i in range(60)]
    spark.createDataFrame(rows, "stream_id string, seq long, token string").write.parquet(folder)
    stream = spark.readStream.schema("stream_id string, seq long, token string").parquet(folder)
    q = tokens.monitor(stream).writeStream.outputMode("update").format("memory").queryName("verdicts").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r.stream_id: r.degraded for r in spark.table("verdicts").collect()} == {"good": False, "bad": True}
