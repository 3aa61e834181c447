"""The public operators on bytes: size and encoding are checked before any of them runs.

Each takes a BINARY Column and gives ``struct<result, error>``: too many bytes or bytes
that are no UTF-8 have a null result and the message, which names the input; NULL bytes
have neither. ``papyrine.functions.guards.batch`` does the same for whole batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.guards import MOST_BYTES, guarded
from papyrine.operators import chunking, detect, extract, injection, md_urls, prompt, render, rss


def operators(**options) -> dict[str, tuple[Callable[[Column], Column], str]]:
    """Operator and name of its input, by operator name; ``options`` are option objects by operator name."""
    own = lambda name, default: options.get(name, default)
    removals = own("apply_dom_removals_to_html", ((), ()))
    arrays = lambda: [F.array(*map(F.lit, x)).cast("array<string>") for x in removals]
    return {
        "sanitize_rss_html": (lambda c: rss.sanitize_rss_html(c, own("sanitize_rss_html", rss.RssOptions())), "HTML"),
        "html_to_embedding_text": (extract.html_to_embedding_text, "HTML"),
        "apply_dom_removals_to_html": (lambda c: extract.apply_dom_removals(c, *arrays()), "HTML"),
        "get_content_from_html": (lambda c: extract.get_content_from_html(c, own("get_content_from_html", extract.ConvertOptions())), "HTML"),
        "sanitize_rss_content": (prompt.sanitize_rss_content, "HTML"),
        "sanitize_prompt_injection": (lambda c: injection.sanitize_prompt_injection(c, own("sanitize_prompt_injection", False)), "content"),
        "chunk": (lambda c: chunking.chunk_markdown(c, own("chunk", chunking.ChunkOptions())), "text"),
        "render_markdown_to_html": (lambda c: render.render_markdown_to_html(c, own("render_markdown_to_html", render.RenderOptions())), "text"),
        "extract_markdown_urls": (md_urls.extract_markdown_urls, "text"),
        "detect_ai_generated_text": (lambda c: detect.detect_ai_generated_text(c, own("detect_ai_generated_text", detect.THRESHOLD)), "text"),
    }


def on_bytes(name: str, content: Column, most: int = MOST_BYTES, **options) -> Column:
    """An operator by name on bytes."""
    operator, source = operators(**options)[name]
    return guarded(content, operator, source, most)
