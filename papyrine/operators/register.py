"""The operators as SQL functions and table functions, with their options as further arguments."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from papyrine.functions import url_rules
from papyrine.operators import chunking, detect, entities, extract, injection, md_urls, prompt, render, rss
from papyrine.operators.extract import ConvertOptions

DETECTION = "struct<flagged boolean, confidence_score double, confidence_threshold double, classification string, detector string, detector_model_version string, error string>"


def with_defaults(kernel: Callable) -> Callable:
    """The kernel with a null text giving null, and a null option its default."""
    names = list(inspect.signature(kernel).parameters)[1:]

    def call(text, *options):
        return None if text is None else kernel(text, **{k: v for k, v in zip(names, options, strict=False) if v is not None})

    return call


def _feed(text, proxy_images=False, image_proxy_url_prefix=url_rules.PROXY_PREFIX, image_proxy_signing_keys=()):
    return dict(zip(("html", "first_image_src"), rss.sanitize(text, rss.RssOptions(proxy_images, image_proxy_url_prefix, tuple(image_proxy_signing_keys)))))


def _content(text, css_selectors_to_remove=(), content_selectors=(), link_text_content_to_remove=(), link_hrefs_to_remove=(), link_rel_tokens_to_remove=(), use_text_density_filter=False):
    lists = (css_selectors_to_remove, content_selectors, link_text_content_to_remove, link_hrefs_to_remove, link_rel_tokens_to_remove)
    return extract.content_of(text, ConvertOptions(*[tuple(x for x in y if x) for y in lists], use_text_density_filter))


def _removed(text, css_selectors_to_remove=(), html_to_remove=()):
    return extract.apply_removals(text, [x for x in css_selectors_to_remove if x], [x for x in html_to_remove if x])


def _rendered(text, allow_html=False, nofollow_links=True, proxy_images=True, image_proxy_url_prefix=url_rules.PROXY_PREFIX, image_proxy_signing_keys=()):
    return render.render(text, render.RenderOptions(allow_html, nofollow_links, proxy_images, image_proxy_url_prefix, tuple(image_proxy_signing_keys)))


def _chunked(text, min_length=None, max_length=None, phase=None, title=None):
    return chunking._rows(chunking.chunk(text, chunking.ChunkOptions(min_length, max_length, phase, title)))


def _urls(known: md_urls.Suffixes) -> Callable:
    return lambda text: dict(zip(("link_urls", "image_urls"), md_urls.extract(text, known)))


def _detected(scorer: Callable[[], detect.Scorer], detector: str, version: str) -> Callable:
    made: dict[str, detect.Scorer] = {}

    def kernel(text, confidence_threshold=detect.THRESHOLD):
        limit = detect.check_threshold(confidence_threshold)
        got = detect.scored([text], scorer, made)[0]
        flagged = None if got["score"] is None else got["score"] >= limit
        kind = None if flagged is None else "ai" if flagged else "human"
        return {"flagged": flagged, "confidence_score": got["score"], "confidence_threshold": limit, "classification": kind, "detector": detector, "detector_model_version": version, "error": got["error"]}

    return kernel


def scalar_functions(scorer: Callable[[], detect.Scorer] = detect.baseline, detector: str = detect.DETECTOR, version: str = detect.VERSION) -> dict[str, tuple[Callable, str]]:
    """Name, kernel and type of each function that needs Python."""
    return {
        "decode_entities": (entities.decode, "string"),
        "sanitize_rss_html": (_feed, rss.SCHEMA),
        "html_to_markdown": (lambda text: extract.markdown_of(extract.dom.parse(text, fragment=False)), "string"),
        "get_content_from_html": (_content, extract.RESULT),
        "apply_dom_removals_to_html": (_removed, "string"),
        "render_markdown_to_html": (_rendered, "string"),
        "sanitize_admin_html": (lambda text: render.sanitize_admin(text), "string"),
        "extract_markdown_urls": (_urls(md_urls.suffixes()), md_urls.SCHEMA),
        "chunk_markdown": (_chunked, chunking.SCHEMA),
        "detect_ai_generated_text": (_detected(scorer, detector, version), DETECTION),
        "is_safe_link": (lambda text: url_rules.is_safe_link(text), "boolean"),
        "is_safe_image": (lambda text: url_rules.is_safe_image(text), "boolean"),
        "proxied_image_url": (lambda text, prefix=url_rules.PROXY_PREFIX, keys=(): url_rules.to_proxy(text, prefix, tuple(keys)), "string"),
    }


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, {_literal(pattern)}, {_literal(to)})"


def expression_functions(prefix: str) -> dict[str, str]:
    """Name with arguments, type and SQL of each function that is an expression over others."""
    text = _replaced(f"{prefix}decode_entities(content)", injection.FORMAT_SIGNS, " ")
    text = _replaced(text, injection.INJECTION, " ")
    for pattern, to in injection.MARKUP_STEPS:
        text = _replaced(text, pattern, to)
    text = _replaced(text, injection.INJECTION, " ")
    text = f"translate({_replaced(text, injection.ROLE, '$1')}, {_literal(injection.B + injection.R)}, '  ')"
    title = f"btrim({_replaced(text, injection.SPACE, ' ')})"
    body = f"btrim({_replaced(_replaced(text, injection.HORIZONTAL, ' '), injection.BLANK_LINES, chr(10) * 2)}, ' \\n')"
    markdown = f"{prefix}html_to_markdown(html)"
    for pattern, to in extract.COLLAPSING:
        markdown = _replaced(markdown, pattern, to)
    feed = f"{prefix}sanitize_prompt_injection({prefix}sanitize_rss_html(html).html)"
    checked = lambda name, value: f"CASE WHEN {value} IS NULL OR {value} RLIKE {_literal(f'^{prompt.ATTRIBUTE}' + chr(92) + 'z')} THEN {value} ELSE raise_error({_literal(f'{name} must match /^[a-z0-9_-]+$/i')}) END"
    kind = f"coalesce(concat(' contentType=\"', {checked('contentType', 'content_type')}, '\"'), '')"
    wrapped = f"concat('<external-content source=\"', {checked('source', 'source')}, '\"', {kind}, '>\\n', content, '\\n</external-content>', CASE WHEN include_reminder THEN {_literal(prompt.REMINDER)} ELSE '' END)"
    return {
        "sanitize_prompt_injection(content STRING, is_title BOOLEAN DEFAULT false) RETURNS STRING": f"CASE WHEN is_title THEN {title} ELSE {body} END",
        "html_to_embedding_text(html STRING) RETURNS STRING": markdown,
        "sanitize_rss_content(html STRING) RETURNS STRING": feed,
        "wrap_external_content(content STRING, source STRING, content_type STRING DEFAULT NULL, include_reminder BOOLEAN DEFAULT true) RETURNS STRING": wrapped,
        "content_length(content STRING) RETURNS INT": f"length(btrim({_replaced('content', injection.SPACE, ' ')}))",
    }


def register(spark: SparkSession, prefix: str = "", scorer: Callable[[], detect.Scorer] = detect.baseline, detector: str = detect.DETECTOR, version: str = detect.VERSION) -> list[str]:
    """Register all functions; returns their names. In SQL, 1-to-n results unfold with ``LATERAL explode`` or the ``chunks`` table function."""
    names = []
    for name, (kernel, kind) in scalar_functions(scorer, detector, version).items():
        spark.udf.register(prefix + name, F.udf(with_defaults(kernel), kind, useArrow=True))
        names.append(prefix + name)
    for head, body in expression_functions(prefix).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{head} RETURN {body}")
        names.append(prefix + head.split("(")[0])

    @F.udtf(returnType="seq int, level int, header string, breadcrumb string, text string, length int")
    class Chunks:
        def eval(self, text: str, min_length=None, max_length=None, phase=None, title=None):
            for k, c in enumerate(chunking.chunk(text, chunking.ChunkOptions(min_length, max_length, phase, title)) if text is not None else []):
                yield k, c.level, c.header, c.breadcrumb, c.text, c.length

    spark.udtf.register(prefix + "chunks", Chunks)
    return [*names, prefix + "chunks"]
