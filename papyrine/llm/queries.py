"""Queries of the corpus operators over the tables of a folder, whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.llm import languages, lookalikes, main_body, markup, mixing, near_copies, site_lines, spans, splitting, tokenizing, wrappers
from papyrine.llm.corpus import texts
from papyrine.plans.session import bound_arrow_batches
from papyrine.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    bound_arrow_batches(spark)
    return lookalikes.same_looking(texts(spark, folder), lookalikes.model(table(spark, folder, "lang_samples")))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    bound_arrow_batches(spark)
    made = lookalikes.look_classes(texts(spark, folder), lookalikes.model(table(spark, folder, "lang_samples")))
    return made.select("tbl", "id", F.col("class").alias("class_id"), "others")


def p1_text(spark: SparkSession, folder: str) -> DataFrame:
    bound_arrow_batches(spark)
    return lookalikes.normalize(texts(spark, folder), ["tbl", "id"], "text", lookalikes.model(table(spark, folder, "lang_samples")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    bound_arrow_batches(spark)
    made = splitting.pieces(table(spark, folder, "chunks"), table(spark, folder, "chunk_options"))
    return made.filter("oversized AND piece_no = 0 AND chunk_id IS NOT NULL").select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    bound_arrow_batches(spark)
    return splitting.pieces(table(spark, folder, "chunks").dropDuplicates(["chunk_id"]), table(spark, folder, "chunk_options"))


def p2_covered(spark: SparkSession, folder: str) -> DataFrame:
    """Of each chunk with text: whether it was cut, the characters its pieces cover, whether all of them fit and neighbours share the overlap."""
    bound_arrow_batches(spark)
    chunks, options = table(spark, folder, "chunks").dropDuplicates(["chunk_id"]), table(spark, folder, "chunk_options")
    of = splitting.with_limits(chunks.select("chunk_id", "option_id"), options).select("chunk_id", "limit_chars", "overlap_chars")
    order = Window.partitionBy("chunk_id").orderBy("piece_no")
    made = splitting.pieces(chunks, options).join(of, "chunk_id").withColumn("before", F.coalesce(F.lag("span_end").over(order), F.lit(0)))
    shared = F.col("before") - F.col("span_start")
    ok = (F.col("piece_no") == 0) | (shared == F.least(F.col("overlap_chars"), F.col("before")))
    return made.groupBy("chunk_id").agg(
        F.first("oversized").alias("oversized"), F.sum(F.col("span_end") - F.greatest("before", "span_start")).cast("bigint").alias("chars"), F.min(F.col("size") <= F.col("limit_chars")).alias("fits"), F.min(ok).alias("overlap_ok")
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _repeated(spark, folder).select("content_id", "line_no")


def p3_lines(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.site_list(table(spark, folder, "page_contents"), _repeated(spark, folder))


def p3_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.without_lines(table(spark, folder, "page_contents"), _repeated(spark, folder))


def _repeated(spark: SparkSession, folder: str) -> DataFrame:
    bound_arrow_batches(spark, 1000, 4)  # some hundred bytes of arrays for each letter of a batch
    return site_lines.repeated_lines(table(spark, folder, "page_contents"), table(spark, folder, "pages"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    bound_arrow_batches(spark)
    pairs = near_copies.similar_pairs(table(spark, folder, "page_contents"))
    return pairs.select(F.col("a").alias("content_id_a"), F.col("b").alias("content_id_b"))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    bound_arrow_batches(spark)
    made = near_copies.linked_classes(table(spark, folder, "page_contents"))
    return made.select(F.col("id").alias("content_id"), F.col("class").alias("class_id"), F.col("links").cast("bigint").alias("links"))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    bound_arrow_batches(spark)
    fitted = languages.fit(table(spark, folder, "lang_samples"))
    return languages.segments(table(spark, folder, "page_contents").filter(F.col("content").isNotNull()), fitted, ["content_id", "lang"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return languages.wrong_or_mixed(_segments(spark, folder))


def p5_segments(spark: SparkSession, folder: str) -> DataFrame:
    each = _segments(spark, folder).dropDuplicates(["content_id"]).select("content_id", F.posexplode("segments").alias("at", "x"))
    return each.select("content_id", (F.col("at") + 1).alias("seg_no"), "x.*")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    bound_arrow_batches(spark, 500, 8)
    contents, pages = table(spark, folder, "page_contents"), table(spark, folder, "pages")
    return main_body.labelled(contents, pages, main_body.fit(contents, pages, table(spark, folder, "convert_options"), table(spark, folder, "dom_removals")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder).select("content_id", F.explode("furniture").alias("line_no")).distinct()


def p6_main(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder).select("content_id", "content").dropDuplicates(["content_id"])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    bound_arrow_batches(spark)
    read = markup.cleaned(texts(spark, folder), ["tbl", "id"])
    return read.select("tbl", "id", F.explode("kinds").alias("kind")).distinct()


def p7_text(spark: SparkSession, folder: str) -> DataFrame:
    bound_arrow_batches(spark)
    return markup.cleaned(texts(spark, folder), ["tbl", "id"])


def p7_slots(spark: SparkSession, folder: str) -> DataFrame:
    bound_arrow_batches(spark, 500, 8)
    return wrappers.page_slots(table(spark, folder, "pages"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    bound_arrow_batches(spark)
    return tokenizing.encode(table(spark, folder, "documents"))


def p8_offsets(spark: SparkSession, folder: str) -> DataFrame:
    bound_arrow_batches(spark)
    return tokenizing.encode(table(spark, folder, "documents"), offsets=True)


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizing.decode(p8_ids(spark, folder))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    bound_arrow_batches(spark)
    return mixing.mix(mixing.sizes(table(spark, folder, "documents")), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, folder), table(spark, folder, "mix_targets"))


def p9_reached(spark: SparkSession, folder: str) -> DataFrame:
    """Of each target: the share it can have, whether it was reached to 0.02, and whether no record is used too often."""
    targets = table(spark, folder, "mix_targets")
    got = p9_shares(spark, folder).join(targets.select("source", "max_repeats"), "source")
    possible = F.when(F.col("tokens") > 0, F.col("target_share")).otherwise(0.0)
    whole = F.sum(possible).over(Window.partitionBy(F.lit(0)))  # one row per target
    share = F.round(possible / whole, 6)
    return got.select("source", share.alias("share"), (F.abs(F.col("reached_share") - share) <= 0.02).alias("reached"), (F.col("most_copies") <= F.col("max_repeats")).alias("within"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    bound_arrow_batches(spark, 500, 4)
    return spans.shared_spans(table(spark, folder, "documents"))


def p10_share(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_share(table(spark, folder, "documents"), p10_found(spark, folder))


def queries() -> dict[str, Query]:
    """All queries, by name."""
    return {
        "p1_found": p1_found,
        "p1_classes": p1_classes,
        "p1_text": p1_text,
        "p2_found": p2_found,
        "p2_pieces": p2_pieces,
        "p2_covered": p2_covered,
        "p3_found": p3_found,
        "p3_lines": p3_lines,
        "p3_cleaned": p3_cleaned,
        "p4_found": p4_found,
        "p4_classes": p4_classes,
        "p5_found": p5_found,
        "p5_segments": p5_segments,
        "p6_found": p6_found,
        "p6_main": p6_main,
        "p7_found": p7_found,
        "p7_text": p7_text,
        "p7_slots": p7_slots,
        "p8_ids": p8_ids,
        "p8_offsets": p8_offsets,
        "p8_decoded": p8_decoded,
        "p9_mix": p9_mix,
        "p9_shares": p9_shares,
        "p9_reached": p9_reached,
        "p10_found": p10_found,
        "p10_share": p10_share,
    }


_WS = r"\t\n\v\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WIDE = "".join(chr(c) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
_NARROW = "".join(chr(c - 0xFEE0) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))


def _host(url: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim({url}), '(?i)^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\\]*)', 1)), '^.*@', ''), ':\d*$', ''), '^www\.|\.$', '')"


#: Fixed values of the SQL of p1_found, stated apart from the operator: letters drawn as those below them, signs that show nothing, kinds of space.
_FOREIGN = "АВЕЅІЈКМНОРСТХаеорсухіјѕһԁԛԝѵΑΒΕΖΗΙΚΜΝΟΡΤΥΧοё"
_LATIN = "ABESIJKMHOPCTXaeopcyxijshdqwvABEZHIKMNOPTYXoë"
_HIDDEN = (0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF)
_SPACES = (0x09, 0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)


def _plain(text: str) -> str:
    """SQL that maps texts of one look to one text: line ends, ligatures, width forms, spaces, hidden signs, letters of other scripts, composed accents."""
    signs = lambda codes: "concat(" + ", ".join(f"chr({c})" for c in codes) + ")"
    sql = f"replace({text}, chr(13) || chr(10), chr(10))"
    for sign, plain in zip("ﬀﬁﬂﬃﬄ", ("ff", "fi", "fl", "ffi", "ffl")):
        sql = f"replace({sql}, '{sign}', '{plain}')"
    width = range(0xFF01, 0xFF5F)
    sql = f"translate({sql}, {signs(width)}, {signs(c - 0xFEE0 for c in width)})"
    sql = f"translate({sql}, {signs((*_SPACES, *_HIDDEN))}, '{' ' * len(_SPACES)}')"
    return f"nfc_normalize(translate(nfc_normalize({sql}), '{_FOREIGN}', '{_LATIN}'))"


def oracle_sql() -> dict[str, str]:
    """SQL for the queries it can express."""
    whole = "CASE WHEN coalesce(breadcrumb, '') = '' THEN text ELSE breadcrumb || chr(10) || chr(10) || text END"
    letters = f"regexp_replace(lower(strip_accents(replace(replace(replace(translate(line, '{_WIDE}', '{_NARROW}'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'))), '[^\\p{{L}}]+', '', 'g')"
    forms = f"""
            WITH all_texts AS (SELECT DISTINCT 'contents' AS tbl, content_id AS id, content AS text FROM page_contents UNION SELECT DISTINCT 'chunks', chunk_id, text FROM chunks),
            forms AS (SELECT tbl, id, text, {_plain('text')} AS form FROM all_texts WHERE text IS NOT NULL)"""
    lines = f"""
            WITH hosts AS (SELECT page_id, max({_host('url')}) AS page_host FROM pages GROUP BY page_id),
            own AS (SELECT DISTINCT content_id, content, coalesce(nullif({_host('canonical_url')}, ''), page_host, '') AS site FROM page_contents LEFT JOIN hosts USING (page_id) WHERE content IS NOT NULL),
            lines AS (SELECT content_id, site, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM own),
            keyed AS (SELECT content_id, site, line, line_no, replace({letters}, 'ß', 'ss') AS key FROM lines),
            often AS (SELECT site, key, count(DISTINCT content_id) AS contents FROM keyed WHERE length(key) >= 15 GROUP BY site, key HAVING count(DISTINCT content_id) >= 5),
            found AS (SELECT DISTINCT content_id, CAST(line_no AS INTEGER) AS line_no FROM keyed JOIN often USING (site, key))"""
    similar = r"""
            WITH own AS (SELECT DISTINCT content_id, regexp_extract_all(lower(coalesce(title, '') || chr(10) || content), '[\p{L}\p{N}]+') AS w FROM page_contents WHERE content IS NOT NULL),
            grams AS (SELECT DISTINCT content_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT content_id, w, unnest(range(1, len(w) - 1)) AS i FROM own WHERE len(w) >= 50)),
            n AS (SELECT content_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS wording FROM grams GROUP BY content_id),
            both_hold AS (SELECT a.content_id AS a, b.content_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.content_id < b.content_id GROUP BY ALL),
            near_pairs AS (SELECT a AS content_id_a, b AS content_id_b FROM both_hold JOIN n x ON a = x.content_id JOIN n y ON b = y.content_id WHERE k >= 0.5 * (x.n + y.n - k))"""
    shared = """
            WITH w AS (SELECT doc_id, p, md5(substr(text, p + 1, 300)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 299)) AS p FROM documents WHERE length(text) >= 300)),
            s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
            m AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 300 THEN 0 ELSE 1 END AS opens FROM w JOIN s USING (h)),
            r AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m),
            spans AS (SELECT doc_id, CAST(min(p) AS INTEGER) AS span_start, CAST(max(p) + 300 AS INTEGER) AS span_end FROM r GROUP BY doc_id, run)"""
    sized = f"length(regexp_replace(regexp_replace({whole}, '[{_WS}]+', ' ', 'g'), '^ | $', '', 'g')) > CASE WHEN max_length >= 1 THEN max_length ELSE 2048 END"
    return {
        "p1_classes": f"""
            {forms}, kinds AS (SELECT tbl, form, count(*) AS n, count(DISTINCT text) AS k, min(id) AS class_id FROM forms GROUP BY ALL), own AS (SELECT tbl, form, text, count(*) AS same FROM forms GROUP BY ALL)
            SELECT tbl, id, class_id, n - same AS others FROM forms JOIN kinds USING (tbl, form) JOIN own USING (tbl, form, text) WHERE k > 1""",
        "p1_found": f"""
            {forms} SELECT a.tbl, a.id AS id_a, b.id AS id_b FROM forms a JOIN forms b ON a.tbl = b.tbl AND a.form = b.form AND a.id < b.id AND a.text <> b.text""",
        "p2_found": f"SELECT DISTINCT chunk_id FROM chunks LEFT JOIN chunk_options USING (option_id) WHERE text IS NOT NULL AND {sized}",
        "p2_covered": f"SELECT DISTINCT chunk_id, {sized} AS oversized, length(text) AS chars, true AS fits, true AS overlap_ok FROM chunks LEFT JOIN chunk_options USING (option_id) WHERE text IS NOT NULL",
        "p3_found": f"{lines} SELECT content_id, line_no FROM found",
        "p3_lines": f"{lines} SELECT site, min(trim(line)) AS line, contents FROM keyed JOIN often USING (site, key) GROUP BY site, key, contents",
        "p3_cleaned": f"""{lines}, gone AS (SELECT content_id, list(line_no) AS gone FROM found GROUP BY content_id)
            SELECT content_id, array_to_string(list_filter(string_split(content, chr(10)), lambda x, i: NOT list_contains(coalesce(gone, []), i)), chr(10)) AS content FROM page_contents LEFT JOIN gone USING (content_id)""",
        "p4_found": f"{similar} SELECT content_id_a, content_id_b FROM near_pairs",
        "p4_classes": f"""{similar}, ends AS (SELECT content_id_a AS content_id FROM near_pairs UNION ALL SELECT content_id_b FROM near_pairs), l AS (SELECT content_id, count(*) AS links FROM ends GROUP BY content_id)
            SELECT content_id, min(content_id) OVER (PARTITION BY wording) AS class_id, coalesce(links, 0) AS links FROM n LEFT JOIN l USING (content_id)""",
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p9_reached": """
            WITH live AS (SELECT DISTINCT source FROM documents WHERE length(text) > 0), t AS (SELECT source, CASE WHEN source IN (SELECT source FROM live WHERE source IS NOT NULL) THEN target_share ELSE 0 END AS possible FROM mix_targets)
            SELECT source, round(possible / sum(possible) OVER (), 6) AS share, true AS reached, true AS within FROM t""",
        "p10_found": f"{shared} SELECT * FROM spans",
        "p10_share": f"""{shared}, n AS (SELECT doc_id, max(length(coalesce(text, ''))) AS n_chars FROM documents GROUP BY doc_id), k AS (SELECT doc_id, CAST(sum(span_end - span_start) AS BIGINT) AS shared_chars FROM spans GROUP BY doc_id)
            SELECT doc_id, n_chars, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN n_chars > 0 THEN coalesce(shared_chars, 0) / n_chars ELSE 0.0 END AS shared_share FROM n LEFT JOIN k USING (doc_id)""",
    }
