"""Look-alikes, splitting, languages, main body, markup, tokenizing, mixing."""

from __future__ import annotations

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrine.llm import languages, lookalikes, main_body, markup, mixing, splitting, tokenizing

SAMPLES_OF_SCRIPTS = ["signal letter window council market we see a cop there and then the river was near", "сигнал письмо окно совет рынок мы видим сор и пар на поле", None]
needs_tokenizer = pytest.mark.skipif(not os.path.exists(f"{tokenizing.TOKENIZER_DIR}/{tokenizing.TOKENIZER}.json"), reason="no tokenizer files")


# look-alikes


@pytest.fixture(scope="module")
def reader(spark):
    return lookalikes.Reader(lookalikes.fit(SAMPLES_OF_SCRIPTS, lookalikes.confusables(spark)))


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Ｗｉｄｅ １２！", "Wide 12!"),
        ("a\u00a0b\u2009c\u3000d", "a b c d"),
        ("zero\u200bwidth\u00ad\u2060\ufeff", "zerowidth"),
        ("cafe\u0301", "café"),
        ("ﬁne ﬂow", "fine flow"),
        ("\u0441ouncil m\u0430rk\u0435t", "council market"),
        ("ΑΒΟ text", "ABO text"),
        ("окно \u0063игнaл", "окно сигнал"),
        ("line\r\nend", "line\nend"),
        ("Οne", "One"),
    ],
)
def test_same_look(reader, a, b):
    assert reader.normal(a) == reader.normal(b) == reader.normal(reader.normal(a))


@pytest.mark.parametrize(("a", "b"), [("Text", "text"), ("cafe", "café"), ("a.", "a;"), ("x2", "x3"), ("a b", "ab"), ("x²", "x2"), ("a\nb", "a b"), ("½", "1/2"), ("shop", "ship"), ("l1", "ll")])
def test_different_look(reader, a, b):
    assert reader.normal(a) != reader.normal(b)


def test_script_choice(reader):
    assert reader.normal("окно \u0063игнал") == "окно сигнал"
    assert reader.normal("text with сигнал inside") == "text with сигнал inside"
    assert reader.normal("m\u0430rket") == "market" and reader.normal("") == ""
    assert reader.normal("мы видим cop на поле") == "мы видим сор на поле" and reader.normal("we see a сор there") == "we see a cop there"


def test_scores_decide(reader):
    """Other character scores give other scripts: words that several scripts can write follow the search, and nothing else does."""
    from dataclasses import replace

    ambiguous = ["see", "ѕее", "ѕеe а"]
    other = replace(reader.fitted, bigrams={"Latin": {}, "Cyrillic": {a + b: -0.1 for a in "^арехосѕу" for b in "арехосѕу"}})
    assert all(reader.normal(t).isascii() for t in ambiguous)
    assert all(not lookalikes.Reader(other).normal(t).isascii() for t in ambiguous)
    assert lookalikes.Reader(other).normal("market сигнал") == "market сигнал"


def test_paths_are_best(reader):
    """The search against all paths of a few words."""
    import itertools

    words = ["сор", "a", "see", "рар", "window", "о"]
    offers = [reader.paths(w) for w in words]
    value = lambda path: reader.fitted.shares[path[0]] + sum(offers[i][s][0] for i, s in enumerate(path)) - lookalikes.BETWEEN * sum(a != b for a, b in zip(path, path[1:]))
    best = max(itertools.product(*offers), key=value)
    got = [lookalikes.script_of(next(c for c in w)) for w in reader.chosen(words)]
    assert value(got) == pytest.approx(value(best))


@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet="aceopxyАВСаесорхуо ABEHiіjһ.йё\u0301\u200b\u00a0", max_size=30), r=st.randoms(use_true_random=False))
def test_swapping_shapes_changes_nothing(reader, text, r):
    rows = {c: row for row in reader.fitted.shapes for c in row}
    swapped = "".join(r.choice(rows[c]) if c in rows else c for c in text)
    assert reader.normal(text) == reader.normal(swapped)


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="acehiopsxy ABCTXmté.", max_size=40))
def test_short_cut_is_the_search(reader, text):
    """Where the search is left out, it would have left the text as it is."""
    import unicodedata

    words = reader.split(unicodedata.normalize("NFD", text))[1::2]
    assert reader.latin_first
    if reader.latin_stays(text):
        assert reader.chosen(words) == words


def test_same_looking_pairs(spark, reader):
    rows = [("c", 1, "market \u0430"), ("c", 2, "market a"), ("c", 2, "market a"), ("c", 3, "Market a"), ("c", 4, None), ("c", 5, None), ("k", 2, "market \u0430"), ("c", 6, "market a"), ("c", 7, ""), ("c", 8, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "tbl string, id bigint, text string, form string")
    got = {tuple(r) for r in lookalikes.same_looking(df, reader.fitted).collect()}
    assert got == {("c", 1, 2), ("c", 1, 6)}
    assert lookalikes.same_looking(df.limit(0), reader.fitted).count() == 0
    classes = {tuple(r) for r in lookalikes.look_classes(df, reader.fitted).collect()}
    assert classes == {("c", 1, 1, 2), ("c", 2, 1, 1), ("c", 6, 1, 1)} and lookalikes.look_classes(df.limit(0), reader.fitted).count() == 0


def test_model_of_all_samples(spark):
    """No sample is left out, however many there are: here those after the first 10,000 are the only ones of their script."""
    rows = [(i, "xx", "river window" if i < 10_000 else "мы видим сор") for i in range(22_000)] + [(5, "xx", None), (5, "xx", "river"), (None, "xx", "Ａ\u0301 river"), (22_000, "xx", "")]
    df = spark.createDataFrame(rows, "sample_id int, lang string, text string").repartition(7)
    got, skeletons = lookalikes.model(df), lookalikes.confusables(spark)
    assert got == lookalikes.fit([text for _, _, text in rows], skeletons)
    assert lookalikes.Reader(got).normal("cop") == "сор"
    assert lookalikes.model(df.limit(0)) == lookalikes.fit([], skeletons)


def test_counts_of_parts_add_up(monkeypatch):
    """Words held at once change no count, and counts of single samples add up to those of all."""
    from collections import Counter

    samples = [*SAMPLES_OF_SCRIPTS, "one сигнал One", "сиgнал ok 手机a"] * 3
    whole = lookalikes.count(samples)
    monkeypatch.setattr(lookalikes, "REMEMBERED", 2)
    assert lookalikes.count(samples) == whole == {s: sum((lookalikes.count([x])[s] for x in samples), Counter()) for s in lookalikes.SCRIPTS}
    assert whole["Latin"][""] == 3 * (16 + 4) and whole["Cyrillic"][""] == 3 * (12 + 1)
    assert whole["Latin"]["手机"] == 3 and whole["Latin"]["^o"] == 3 * 3 and "gн" not in whole["Latin"] + whole["Cyrillic"]


# splitting


def check_split(text: str, limit: int, overlap: int, crumb: str = "") -> None:
    got = splitting.split(text, limit, overlap, crumb)
    sizes = [splitting.size(f"{h}\n\n{text[a:b]}" if h.strip() else text[a:b]) for h, a, b in got]
    assert max(sizes) <= limit, (limit, sizes)
    assert got[0][1] == 0 and got[-1][2] == len(text)
    for (_, a, b), (_, c, d) in zip(got, got[1:]):
        assert a <= c <= b <= d and c < d
    if len(got) > 1 and overlap and limit - splitting.size(crumb) > 3 * overlap:
        assert all(b - c == min(overlap, b) or c == 0 for (_, _, b), (_, c, _) in zip(got, got[1:]))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n#-|`>e\u0301\u3000。", max_size=300), st.integers(1, 60), st.integers(0, 20), st.sampled_from(["", "A", "A > B > long heading here"]))
def test_split_always_fits(text, limit, overlap, crumb):
    if text:
        check_split(text, limit, overlap, crumb)


def test_split_boundaries(prose):
    text = "# A\n\n" + prose(1, 60) + "\n\n# B\n\n" + prose(2, 60) + "\n\n- one item\n- two items\n\n```\ncode # x\n\nmore\n```\n"
    got = splitting.split(text, 600, 0)
    assert any(text[a:b].startswith("# B") for _, a, b in got)
    assert not any(text[a:b].strip().startswith("more") for _, a, b in got)
    check_split(prose(3, 2400), 300, 50, "H > I")
    check_split("x" * 100_000, 500, 20)
    check_split("e\u0301" * 2000, 101, 0)
    assert all(text_ok(x) for x in [("e\u0301" * 2000)[a:b] for _, a, b in splitting.split("e\u0301" * 2000, 101, 0)])
    assert splitting.split("", 5) == [("", 0, 0)] and splitting.size(" a \n b ") == 3


def text_ok(part: str) -> bool:
    return not part.startswith("\u0301")


def test_pieces(spark, prose):
    options = spark.createDataFrame([(1, None, None), (2, 100, 10), (3, 0, 5)], "option_id int, max_length int, overlap int")
    rows = [(1, 1, None, "short"), (2, 2, "A", prose(1)), (2, 2, "A", prose(1)), (3, 2, None, None), (4, 9, "", prose(2)), (5, 3, None, ""), (6, 2, "C" * 300, "some text"), (7, None, None, "x" * 3000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "chunk_id bigint, option_id int, breadcrumb string, text string, limit_chars int")
    got = splitting.pieces(df, options).collect()
    over = {r.chunk_id for r in got if r.oversized}
    assert over == {2, 6, 7} and 3 not in {r.chunk_id for r in got}
    limits = {2: 100, 6: 100}
    assert all(r.size <= limits.get(r.chunk_id, 2048) for r in got)
    assert splitting.pieces(df.limit(0), options).count() == 0


# languages

SAMPLES = [
    ("en", "the river and the garden of a village with that letter which they have for us when it was not here"),
    ("de", "der Fluss und der Garten in einem Dorf mit dem Brief den wir haben und es ist nicht hier wenn sie das sagen"),
    ("fr", "la rivière et le jardin dans un village avec cette lettre que nous avons pour les gens quand il est dans la rue"),
    ("ru", "река и сад в деревне с письмом которое мы имеем для них когда это было не здесь потому что они"),
]


def test_languages():
    reader = languages.Reader(languages.Model(SAMPLES * 3))
    en, de, ru = (t for _, t in (SAMPLES[0], SAMPLES[1], SAMPLES[3]))
    assert [(s[0], s[2], s[3]) for s in reader.read(f"{en}\n\n{en}")] == [("en", 1, 3)]
    assert [(s[0], s[2], s[3]) for s in reader.read(f"{en}\n{en}\n\n{de}\n{de}\n123 456\n{ru}\n{ru}")] == [("en", 1, 3), ("de", 4, 6), ("ru", 7, 8)]
    assert reader.read("") == reader.read("12 34\n--") == [] and all(0 <= s[1] <= 1 for s in reader.read(de))
    assert reader.read(f"{en}\n```\nder die das und\n```\n{en}")[0][0] == "en" and len(reader.read(f"{en}\n```\nder die das und\n```\n{en}")) == 1


def test_wrong_labels(spark):
    fitted = languages.Model(SAMPLES * 3)
    en, de = SAMPLES[0][1], SAMPLES[1][1]
    rows = [(1, "en", en), (2, "en-GB", en), (3, "English", en), (4, "de", en), (5, None, en), (6, "??", de), (7, "en", f"{en}\n\n{en}\n\n{de}\n\n{de}"), (8, "en", None), (9, "x", "123"), (5, None, en), (10, "deu", de), (11, "en_US", en)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "content_id bigint, lang string, content string, segments string")
    got = {tuple(r) for r in languages.wrong_or_mixed(languages.segments(df, fitted, ["content_id", "lang"])).collect()}
    assert got == {(4, 0, "en"), (5, 0, "en"), (6, 0, "de"), (7, 1, "en"), (7, 2, "de")}


# main body


def site_page(i: int, prose) -> tuple[str, str]:
    lines = [prose(10 * i + k, 24) for k in range(3)]
    html = f"<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav><main><h1>Title {i} river</h1>{''.join(f'<p>{x}</p>' for x in lines)}</main><footer><p>© {2000 + i} Site. All rights reserved</p></footer></body></html>"
    return "\n".join(["Home · News", f"# Title {i} river", "", *lines, f"© {2000 + i} Site. All rights reserved"]), html


def test_main_body(spark, prose):
    made = {i: site_page(i, prose) for i in range(40)}
    contents = spark.createDataFrame([(i, i, 1, c) for i, (c, _) in made.items()] + [(0, 0, 1, made[0][0]), (90, 90, 1, None), (91, 91, 1, ""), (92, 92, 1, made[1][0])], "content_id bigint, page_id bigint, site_id int, content string")
    pages = spark.createDataFrame([(i, h) for i, (_, h) in made.items()] + [(0, made[0][1]), (92, None)], "page_id bigint, html string")
    none = spark.createDataFrame([], "site_id int, content_selectors array<string>")
    gone = spark.createDataFrame([], "site_id int, css_selectors_to_remove array<string>")
    field = main_body.fit(contents, pages, none, gone, sample=60)
    got = {r.content_id: r for r in main_body.labelled(contents, pages, field).collect()}
    assert set(got) == {*range(40), 91, 92}
    assert all(got[i].furniture == [1, 7] for i in [*range(40), 92]), [got[i].furniture for i in got]
    assert got[91].furniture == [] and got[3].content.startswith("# Title 3")
    assert main_body.labelled(contents.limit(0), pages, field).count() == 0
    assert main_body.train([]).decode([0.0, -1.0]) == [0, 0]
    again = main_body.Field.of(field.frame(spark))
    assert (again.weights == field.weights).all() and (again.moves == field.moves).all()


def test_chain_marginals():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    unary, moves, live = r.normal(size=(1, 4, 2)), r.normal(size=(2, 2)), np.array([[True, True, True, False]])
    paths = list(itertools.product((0, 1), repeat=3))
    weight = np.array([np.exp(sum(unary[0, t, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in paths])
    z, marginal, pairs = main_body._chains(unary, live, moves)
    assert abs(z - np.log(weight.sum())) < 1e-9
    assert abs(marginal[0, 1, 1] - sum(w for w, p in zip(weight, paths) if p[1]) / weight.sum()) < 1e-9
    assert abs(pairs[0, 1] - sum(w * sum(a == 0 and b == 1 for a, b in zip(p, p[1:])) for w, p in zip(weight, paths)) / weight.sum()) < 1e-9
    own = main_body.Field(np.zeros(1), moves)
    best = max(paths, key=lambda p: sum((unary[0, t, 1] - unary[0, t, 0]) * y for t, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])))
    assert tuple(own.decode([unary[0, t, 1] - unary[0, t, 0] for t in range(3)])) == best


# markup


@pytest.mark.parametrize(
    ("text", "kinds", "out"),
    [
        ("plain 3 < 4 & 5 > 4, $3, $4 {x} [sic] #12 a_b_c C:\\temp\\new 2 == 2", [], None),
        ("see https://a.test/b_c_d", [], None),
        ("# Head\n\ntext **bold** _it_", ["markdown"], "Head\n\ntext bold it"),
        ("- a\n- b\n1. c", ["markdown"], "• a\n• b\n• c"),
        ("[t](http://x) ![alt](y.png)", ["markdown"], "t alt"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"], "a\tb\n1\t2"),
        ("```\n<b>x</b> \\item {{t}}\n```", ["markdown"], "    <b>x</b> \\item {{t}}"),
        ("<p>Hi &amp; <b>bye</b></p><!-- c -->", ["html"], "Hi & bye"),
        ("<ul><li>a<li>b</ul>", ["html"], "• a\n• b"),
        ("== H ==\n'''b''' [[L|x]] {{cite|a=1}}", ["wiki"], "H\n\nb x "),
        ("{|\n|+ Cap\n|-\n! h || k\n|-\n| 1 || 2\n|}", ["wiki"], "Cap\nh\tk\n1\t2"),
        ("\\section{S}\n\\emph{e} $x^{2}$ ~\\ref{a} \\begin{itemize}\n\\item q\n\\end{itemize}", ["latex"], None),
        ("$$ a_{1} \\leq b $$", ["latex"], "a_{1} \\leq b"),
        ("> quoted", ["markdown"], "quoted"),
        ("", [], ""),
    ],
)
def test_markup(text, kinds, out):
    clean, found = markup.clean(text)
    assert found == kinds
    if kinds == [] or out is not None:
        assert clean == (text if out is None else out)
    if found and "```" not in text:
        assert "latex" in found or not {"<", "**", "[[", "{{"} & {s for s in ("<", "**", "[[", "{{") if s in clean}


def test_markup_columns(spark):
    df = spark.createDataFrame([(1, "*a* b", "k"), (2, None, "k"), (3, "", "k"), (4, "x " * 100_000 + "<b>", "k")], "id bigint, text string, kinds string")
    got = {r.id: r for r in markup.cleaned(df, ["id"]).collect()}
    assert got[1].text == "a b" and got[2].text is None and got[2].kinds == [] and got[3].text == "" and got[4].kinds == ["html"]


# tokenizing


@needs_tokenizer
def test_round_trip(spark):
    texts = ["Hello world", "naïve café ½ 日本語 \U0001f468\u200d\U0001f469 \t\n  x", "<|endoftext|> is text", "", None, "a" * 50_000, "\u0301\ufeff"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    coded = {r.doc_id: r for r in tokenizing.encode(df, offsets=True).collect()}
    assert coded[3].ids == coded[4].ids == [] and 50256 not in coded[2].ids
    plain = {r.doc_id: r.ids for r in tokenizing.encode(df).collect()}
    for i, t in enumerate(texts):
        assert plain[i] == coded[i].ids and tokenizing.decode_ids(plain[i]) == (t or "")
        assert "".join(tokenizing.decode_pieces(plain[i])) == (t or "")
        assert all(0 <= a <= b <= len(t or "") for a, b in zip(coded[i].starts, coded[i].ends))
    assert [coded[0].starts, coded[0].ends] == [[0, 5], [5, 11]]
    back = {r.doc_id: r.text for r in tokenizing.decode(tokenizing.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in tokenizing.count_tokens(df, ["doc_id"]).collect()} == {i: len(v) for i, v in plain.items()}
    assert tokenizing.encode(df.limit(0)).count() == 0


# mixing


def plain_seats(w: list[float], seats: int, caps: list[int]) -> list[int]:
    from fractions import Fraction

    got = [0] * len(w)
    for _ in range(seats):
        best = [i for i in range(len(w)) if w[i] > 0 and got[i] < caps[i]]
        if not best:
            break
        i = max(best, key=lambda i: (Fraction(w[i]) / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.1, 0.2, 0.25, 0.5, 1.0, 3.0]), min_size=1, max_size=6), st.integers(0, 60), st.data())
def test_apportionment(w, seats, data):
    caps = [data.draw(st.integers(0, 40)) for _ in w]
    got, want = mixing.sainte_lague(w, seats, caps), plain_seats(w, seats, caps)
    assert got == want


def test_apportionment_is_quick_for_many_seats():
    got = mixing.sainte_lague([0.2, 0.3, 0.5], 10**12)
    assert sum(got) == 10**12 and got[2] == 5 * 10**11


def test_mix(spark):
    r = random.Random(4)
    rows = [(i, "big" if i % 3 else "mid", r.randint(50, 400)) for i in range(600)] + [(1000 + i, "tiny", 100) for i in range(6)] + [(2000, "stray", 500)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 2), ("tiny", 0.05, 3), ("none", 0.05, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sized, targets, block_tokens=64, shard_tokens=20_000)
    shares = {x.source: x for x in mixing.shares(mixed, targets).collect()}
    assert abs(shares["big"].reached_share - 0.5 / 0.95) < 0.02 and abs(shares["tiny"].reached_share - 0.05 / 0.95) < 0.02
    assert shares["none"].reached_share == 0 and shares["tiny"].most_copies <= 3 and shares["mid"].most_copies <= 2
    uses = mixed.groupBy("doc_id", "copy").count().filter("count > 1").count()
    assert uses == 0 and mixed.filter("source = 'stray'").count() == 0
    assert sorted(mixed.collect()) == sorted(mixing.mix(sized.repartition(7), targets, block_tokens=64, shard_tokens=20_000).collect())
    assert mixing.mix(sized.limit(0), targets).count() == 0


def test_every_language_is_tried():
    """Three languages of larger gain improve nothing by mixing; the fourth does."""
    import numpy as np

    model = languages.Model([(x, "word") for x in ("de", "en", "es", "fr", "it")])
    scores = np.zeros((101, 5))
    scores[:50, 1:4], scores[50:, 1:4], scores[:, 4] = 0.5, -0.7, -5.0
    scores[100, 1:4], scores[100, 4] = -0.7, 24.0
    scores[:, 0] += 1e-6
    reader = languages.Reader(model)
    reader.lines = lambda text: (scores, np.ones(101, int))
    assert "it" in [s[0] for s in reader.read("")]


HOSTILE = (
    "_a ", "<!-- ", "{|\n", "$$a\n\\[b ", "\\begin{align} ", "<script ", "{{a", "\\a{b", "$a=", "\\a[", "[a](b \"x", "`a ", "<a b=", "> ", "*a ", "~~a ", "[[a|", "''a ", "<div>x", "<p>same</p>", "<a \"",
    "```\nx\n```\n", "== a =", "# a\n", "- a\n", "a. ", "''' ", "<![CDATA[ ", "| --- ",
)


@pytest.mark.parametrize("part", HOSTILE)
def test_kernels_are_linear(part):
    """Four times the text costs about four times the time, whatever is left open in it."""
    import time

    kernels = (markup.clean, lambda t: main_body.align(["same", "x"] * 50, t), lambda t: splitting.split(t, 500, 20))
    for kernel in kernels:
        took = []
        for size in (60_000, 240_000):
            text = part * (size // len(part))
            began = time.perf_counter()
            kernel(text)
            took.append(time.perf_counter() - began)
        assert took[1] < 9 * took[0] + 0.5, (part, took)


def test_long_lines_are_linear():
    import time

    began = time.perf_counter()
    for text in ("# a" + " " * 500_000 + "b", "== a" + " " * 500_000 + "b", "--\n" + " " * 500_000 + "x --", "[http:a" + " " * 500_000, "\\a{" * 100_000 + "}" * 100_000, "{{a" * 100_000 + "}}" * 100_000, "== a" + "=" * 300_000 + "x"):
        markup.clean(text)
        splitting.split(text, 500, 20)
    assert time.perf_counter() - began < 60
