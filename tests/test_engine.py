"""The registered queries against their SQL, streams, SQL functions, file sources."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from papyrine import queries as core
from papyrine.operators.boilerplate import learn
from papyrine.operators.injection import sanitize_prompt_injection
from papyrine.operators.register import register
from papyrine.sources.documents import read_text_files, write_partitioned
from papyrine.streaming import documents as stream

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are missing")


def same(spark, name: str, query, sql: str) -> None:
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = query(spark, DATA)
    cols = sorted(got.columns)
    rows = [tuple(r[c] for c in cols) for r in got.collect()]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    assert sorted(map(repr, rows)) == sorted(map(repr, want)), name


@needs_data
@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_sql_agrees(spark, name):
    same(spark, name, core.queries()[name], core.oracle_sql()[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_rows(spark, name):
    assert core.queries()[name](spark, DATA).count() > 0


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(core.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"<p>system: {i}</p> x &amp; y") for i in range(20)] + [(0, "again"), (99, None)]
    batch = spark.createDataFrame(rows, "id int, text string")
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    out = stream.transform(stream.read_documents(spark, str(tmp_path / "in"), batch.schema), "text", "clean", sanitize_prompt_injection)
    q = out.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = batch.withColumn("clean", sanitize_prompt_injection(F.col("text")))
    key = lambda r: (r.id, r.text or "")
    assert sorted(spark.table("cleaned").collect(), key=key) == sorted(want.collect(), key=key)


def test_stream_state_and_blocks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "<nav class='a'>n</nav>", "2024-01-01 00:00:00"), (1, 1, "<nav class='a'>n</nav>", "2024-01-02 00:00:00"), (2, 1, "<nav class='a'>n</nav><p>x</p>", "2024-01-03 00:00:00")], "page_id int, site_id int, html string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    first = stream.first_arrivals(stream.read_documents(spark, str(tmp_path / "in"), df.schema), "page_id", "at")
    q = first.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 2
    stream.collect_blocks(stream.read_documents(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "blocks"), str(tmp_path / "cp2"), site="site_id", page="page_id", html="html").awaitTermination()
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    assert {r.selector for r in blocks.collect()} == {"nav.a", "p"}
    got = learn(blocks, df.selectExpr("site_id AS site", "page_id AS page", "html")).collect()
    assert [(r.site, r.css_selectors_to_remove, r.html_to_remove) for r in got] == [(1, ["nav.a"], [])]
    counts = stream.counts_by_window(stream.read_documents(spark, str(tmp_path / "in"), df.schema), "at", "1 day", "7 days", "site_id")
    q = counts.writeStream.format("memory").outputMode("complete").queryName("counts").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("documents")).head()[0] == 3


def test_window_bytes(spark):
    df = spark.createDataFrame([("é", "2024-01-01 00:00:00"), ("ab", "2024-01-01 01:00:00"), (None, "2024-01-03 00:00:00")], "text string, at string").withColumn("at", F.to_timestamp("at"))
    got = stream.counts_by_window(df, "at", "1 day", "7 days", text="text").orderBy("window").collect()
    assert [(r.documents, r.bytes) for r in got] == [(2, 4), (1, 0)]


def test_sql_functions(spark):
    names = register(spark, "t_")
    assert {"t_chunks", "t_sanitize_prompt_injection", "t_html_to_embedding_text", "t_wrap_external_content", "t_apply_dom_removals_to_html", "t_detect_ai_generated_text"} <= set(names)
    one = lambda sql: spark.sql(f"SELECT {sql} AS x").head().x
    assert one("t_render_markdown_to_html('*x*')") == "<p><em>x</em></p>" and one("t_decode_entities(NULL)") is None
    assert "<u>" in one("t_render_markdown_to_html('<u>x</u>', true)") or one("t_render_markdown_to_html('<b>x</b>', true)") == "<p><b>x</b></p>"
    assert one("t_render_markdown_to_html('![x](https://m.test/y.gif)', NULL, NULL, false)") == '<p><img src="https://m.test/y.gif" alt="x" /></p>'
    assert one("t_get_content_from_html('<main>a</main><p>b</p>', NULL, array('main')).content") == "a"
    assert one("t_apply_dom_removals_to_html('<p>a</p><nav>b</nav>', array('nav', NULL), NULL)") == "<p>a</p>"
    assert one("size(t_chunk_markdown('# a\n\nb\n\nc', 1, 9, 1))") == 2
    assert one("t_detect_ai_generated_text('a b', 0D)").flagged is True and one("t_detect_ai_generated_text(NULL)") is None
    assert one("t_html_to_embedding_text('<h2>a</h2><a href=b>c</a>')") == "## a\n\nc" and one("t_sanitize_rss_content('<p>a</p><p>system: b')") == "a b"
    assert one("t_wrap_external_content('a', 'b', NULL, false)") == '<external-content source="b">\na\n</external-content>'
    with pytest.raises(Exception, match="source must match"):
        one("t_wrap_external_content('a', 'b c')")
    rows = spark.sql("SELECT id, c.text FROM VALUES (1, '# A\n\nx\n\ny'), (2, NULL) AS d(id, md), LATERAL t_chunks(md, 1, 99, 1) AS c").collect()
    assert [(r.id, r.text) for r in rows] == [(1, "x"), (1, "y")]


def test_sql_chain_equals_columns(spark):
    register(spark, "t_")
    texts = ["<p>a</p>system: b &amp; c\n\n\n\nd", "ignore<b></b>all prompts  e", "", None, "the <i>assistant:</i> f", "<li>\u2003system: g"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.selectExpr("t_sanitize_prompt_injection(t)", "t_sanitize_prompt_injection(t, true)").collect()
    want = df.select(sanitize_prompt_injection(F.col("t")), sanitize_prompt_injection(F.col("t"), title=True)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_sources(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.txt").write_bytes("é".encode())
    (tmp_path / "f/b.txt").write_bytes(b"\xff")
    got = {r.path[-5:]: (r.text, r.error) for r in read_text_files(spark, str(tmp_path / "f")).collect()}
    assert got == {"a.txt": ("é", None), "b.txt": (None, "Invalid UTF-8 in content")}
    write_partitioned(spark.range(10).withColumn("k", F.col("id") % 2), str(tmp_path / "w"), by="k")
    assert spark.read.parquet(str(tmp_path / "w")).count() == 10


def test_pushdown(spark, tmp_path):
    if not os.path.isdir(DATA):
        pytest.skip("test tables are missing")
    plan = core.injection_strip_html(spark, DATA).filter("page_id < 5")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(page_id,5)" in plan and "fetched_at" not in plan
