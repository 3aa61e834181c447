"""One consistent form for texts that look the same but differ in their characters.

Per text: width forms, ligatures and kinds of space are mapped to plain characters,
ignorable characters are deleted, accents are composed, and every word is written in
one script. Letters of several scripts that are drawn alike form a shape; the relation
is generated from the confusables of Unicode's security data, which the ICU library of
Spark holds. Words are lattices: each shape offers its letters in all scripts. Paths
are script-consistent: where scripts can write the whole word, these are its paths;
only a word that no script can write may change script inside, at a price. Paths are
scored by character bigrams of their script; the Viterbi search runs over all words of
the text, with a price on changing script between words, and its start weighs the
scripts by their share of the samples. Lattices depend on shapes alone, so texts that
look the same come out equal, and a shape never maps to another shape, so texts that
look different stay different.

Superscripts, fractions, circled or styled letters are visible and stay. A carriage
return before a line feed shows nothing; other line separators become U+000A.
Results: null stays null, '' stays ''; a text of ignorable characters only becomes ''.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.plans.session import cut_lineage

SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Coptic", "Cherokee")
#: Price of changing script inside a word and between words, in natural logarithms.
CHANGE, BETWEEN = 12.0, 4.0
UNSEEN = -9.0
#: Words a worker remembers; the memory is emptied when full, which changes no result.
REMEMBERED = 200_000

_KEEP_JOINER = "\u0600-\u0dff\u200d☀-➿\ufe0f\U0001f000-\U0001faff"
_JOINERS = re.compile(f"(?<![{_KEEP_JOINER}])[\u200c\u200d]")
_MARKS = "\u0300-\u036f"


@lru_cache(maxsize=1 << 16)
def script_of(ch: str) -> str | None:
    """The script of a letter, if it is one of ``SCRIPTS``."""
    name = unicodedata.name(ch, "").split(" ", 1)[0].capitalize() if ch.isalpha() else ""
    return name if name in SCRIPTS else None


def candidates() -> list[str]:
    """Cased letters of the scripts that are no composition of others."""
    return [c for c in map(chr, range(0x41, 0x10000)) if script_of(c) and unicodedata.category(c) in ("Lu", "Ll") and not unicodedata.decomposition(c)]


def confusables(spark: SparkSession) -> dict[str, str]:
    """The skeleton of each candidate letter, from the ICU library on the driver."""
    letters = candidates()
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    return dict(zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True))


def shapes(skeletons: dict[str, str]) -> list[tuple[str, ...]]:
    """Groups of letters of one skeleton and one case, one of a script, in the order of SCRIPTS.

    Of several letters of a script, which are drawn apart, the skeleton itself stays, or
    else the first whose other case has one skeleton with the other case of another script's letter, or else the first.
    """
    groups: dict[tuple[str, bool], list[str]] = {}
    for c, skeleton in skeletons.items():
        groups.setdefault((skeleton, c.isupper()), []).append(c)
    out = []
    for (skeleton, _), letters in groups.items():
        kept = []
        for script in SCRIPTS:
            own = [c for c in letters if script_of(c) == script]
            if skeleton in own:
                own = [skeleton]
            elif len(own) > 1:
                partners = {skeletons.get(c.swapcase()) for c in letters if script_of(c) != script} - {None}
                own = [*(c for c in own if skeletons.get(c.swapcase()) in partners), *own][:1]
            kept += own
        if len({script_of(c) for c in kept}) > 1:
            out.append(tuple(kept))
    return sorted(out)


@lru_cache(maxsize=1)
def plain_forms() -> dict[int, str | None]:
    """Translation by rule from the Unicode data: width forms, ligatures, spaces, ignorable characters."""
    out: dict[int, str | None] = {}
    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if ch == " ":
            continue
        if kind == "Zs" or ch in "\t\u2800":
            out[code] = " "
        elif ch in "\r\x0b\x0c\x85\u2028\u2029":
            out[code] = "\n"
        elif (kind in ("Cf", "Cc") and ch not in "\n\u200c\u200d" and not 0x600 <= code <= 0x8FF) or ch in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" or 0x180B <= code <= 0x180F or 0xFE00 <= code <= 0xFE0E or 0xE0000 <= code <= 0xE0FFF:
            out[code] = None
        elif (d := unicodedata.decomposition(ch))[:1] == "<":
            tag, *codes = d.split()
            text = "".join(chr(int(x, 16)) for x in codes)
            ligature = tag == "<compat>" and len(text) > 1 and all(unicodedata.category(x)[0] == "L" for x in text)
            if tag in ("<wide>", "<narrow>") or ligature:
                out[code] = text
    return out


@lru_cache(maxsize=1)
def _changed() -> re.Pattern:
    """The characters of ``plain_forms``, as one class of ranges: a search passes over all others quickly."""
    codes = sorted(plain_forms())
    starts = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2]) if c != after - 1]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends)) + "]")


@dataclass(frozen=True)
class Model:
    """What is fitted or generated once: shapes, bigram logarithms by script, and logarithms of the scripts' shares."""

    shapes: list[tuple[str, ...]]
    bigrams: dict[str, dict[str, float]]
    shares: dict[str, float]


class Reader:
    """Brings texts to their one form; remembers words."""

    def __init__(self, fitted: Model):
        self.fitted, self.memory = fitted, {}
        self.shape = {c: row[0] for row in fitted.shapes for c in row}
        self.letter = {row[0]: {script_of(c): c for c in row} for row in fitted.shapes}
        self.to_shape = str.maketrans(self.shape)
        self.words = re.compile(f"(?:[^\\W\\d_]|[{_MARKS}])+")
        self.split = re.compile(f"({self.words.pattern})").split
        self.changed, forms = _changed(), plain_forms()
        self.plain = lambda m: forms[ord(m[0])] or ""
        latin = {c for c in map(chr, range(0x250)) if c.isalpha()} | {chr(c) for c in range(0x1E00, 0x1F00)}
        base = {c: unicodedata.normalize("NFD", c)[0] for c in latin}
        shaped = "".join(f"\\U{ord(c):08x}" for c in self.shape if c not in latin)
        self.foreign = re.compile((f"[{shaped}]|" if shaped else "") + f"(?![{''.join(sorted(latin))}])[^\\W\\d_\u4e00-\u9fff\u3040-\u30ff]")
        # Latin words that another script can write whole
        sets = {s: [c for c in latin if s in self.letter.get(self.shape.get(base[c], ""), ())] for s in SCRIPTS if s != "Latin"}
        either = "|".join(f"[{''.join(sorted(x))}{_MARKS}]+" for x in sets.values() if x)
        self.open = re.compile(f"(?<![^\\W\\d_])(?:{either})(?![^\\W\\d_]|[{_MARKS}])") if either else re.compile("(?!)")
        self.latin_first = all(fitted.shares.get("Latin", 0.0) >= x for x in fitted.shares.values())

    def score(self, letters: str, script: str) -> float:
        known = self.fitted.bigrams.get(script, {})
        bare = "^" + "".join(c for c in letters if not unicodedata.combining(c)).lower()
        return sum(known.get(bare[i : i + 2], UNSEEN) for i in range(len(bare) - 1))

    def paths(self, word: str) -> dict[str | None, tuple[float, str]]:
        """Score and letters of each script that can write the decomposed word whole; of the best change of scripts under None if there is none, and no path of a word of other scripts."""
        if (known := self.memory.get(word)) is not None:
            return known
        if len(self.memory) >= REMEMBERED:
            self.memory.clear()
        shape = word.translate(self.to_shape)
        out = self.memory[word] = self.memory.setdefault(shape, {}) or self.read(shape)
        self.memory[shape] = out
        return out

    def read(self, word: str) -> dict[str | None, tuple[float, str]]:
        """``paths`` of a word of shapes."""
        offers = [self.letter.get(c) or {script_of(c): c} for c in word]
        bound = [o for o in offers if None not in o]
        out: dict[str | None, tuple[float, str]] = {}
        for s in SCRIPTS if bound else ():
            if all(s in o for o in bound):
                text = "".join(o.get(s) or o[None] for o in offers)
                out[s] = (self.score(text, s), text)
        if bound and not out:
            out[None] = self.mixed(offers)
        return out

    def mixed(self, offers: list[dict]) -> tuple[float, str]:
        """The best path through a lattice that no script can write whole."""
        best: dict[str | None, tuple[float, str]] = {None: (0.0, "^")}  # score and last letter by script
        steps: list[dict[str, str | None]] = []  # for each letter of a script, the script before each of its scripts
        for o in offers:
            if None in o:
                continue
            step, back = {}, {}
            for s in (x for x in SCRIPTS if x in o):
                known = self.fitted.bigrams.get(s, {})
                value = {p: v - (CHANGE if p not in (None, s) else 0.0) + known.get((last + o[s]).lower(), UNSEEN) for p, (v, last) in best.items()}
                back[s] = max(value, key=value.get)
                step[s] = (value[back[s]], o[s])
            best = step
            steps.append(back)
        end = script = max(best, key=lambda s: best[s][0])
        out = []
        for o in reversed(offers):
            if None in o:
                out.append(o[None])
            else:
                out.append(o[script])
                script = steps.pop()[script]
        return best[end][0], "".join(reversed(out))

    def chosen(self, words: list[str]) -> list[str]:
        """Each word in the script of the best path through the words of a text."""
        steps: list[tuple[int, dict, dict]] = []  # open words: their number, paths, and the script before each script
        best = {s: self.fitted.shares.get(s, UNSEEN) for s in SCRIPTS}
        out = list(words)

        def settle(script: str) -> None:
            for k, paths, back in reversed(steps):
                out[k] = paths[script][1]
                script = back[script]
            steps.clear()

        for k, word in enumerate(words):
            paths = self.memory.get(word) or self.paths(word)
            if len(paths) == 1:
                ((script, (_, text)),) = paths.items()
                out[k] = text
                if script is not None and (script not in best or len(best) > 1):
                    if steps:
                        top = max(best, key=best.get)
                        settle(script if script in best and best[script] >= best[top] - BETWEEN else top)
                    best = {script: 0.0}
            elif paths:
                top = max(best, key=best.get)
                change = best[top] - BETWEEN
                back = {s: s if s in best and best[s] >= change else top for s in paths}
                best = {s: v + (best[s] if back[s] == s else change) for s, (v, _) in paths.items()}
                steps.append((k, paths, back))
        settle(max(best, key=best.get))
        return out

    def latin_stays(self, t: str) -> bool:
        """Whether the best path of a text without other scripts is certainly Latin: no run of words that others can write gains by a change what it costs."""
        gain, end, closed = 0.0, 0, False
        for m in self.open.finditer(t):
            if self.words.search(t, end, m.start()):
                gain, closed = 0.0, True
            end = m.end()
            paths = self.memory.get(m[0]) or self.paths(unicodedata.normalize("NFD", m[0]))
            if len(paths) > 1 and "Latin" in paths:
                gain += max(0.0, max([v for v, _ in paths.values()]) - paths["Latin"][0])
                if gain > BETWEEN:
                    return False
        return closed or gain == 0 or self.words.search(t, end) is not None

    def simple(self, text: str) -> str:
        """Plain forms of characters, and none that show nothing; letters as they are."""
        t = text
        if not (t.isascii() and t.isprintable()):
            t = self.changed.sub(self.plain, t.replace("\r\n", "\n") if "\r" in t else t)
            if "\u200c" in t or "\u200d" in t:
                t = _JOINERS.sub("", t)
        return t

    def normal(self, text: str) -> str:
        """The one form of a text."""
        t = self.simple(text)
        if self.latin_first and self.of_latin(t) and self.latin_stays(t):
            return t if t.isascii() else unicodedata.normalize("NFC", t)
        return self.written(t)

    def of_latin(self, t: str) -> bool:
        return t.isascii() or not self.foreign.search(t)

    def written(self, t: str) -> str:
        """A text of plain forms with each word in its script."""
        parts = self.split(unicodedata.normalize("NFD", t))
        parts[1::2] = self.chosen(parts[1::2])
        return unicodedata.normalize("NFC", "".join(parts))

    def readable(self, text: str) -> str:
        """The form in which a reader of languages takes a text: as ``normal``, but a text of Latin letters alone keeps them."""
        t = self.simple(text)
        return unicodedata.normalize("NFC", t) if self.of_latin(t) else self.written(t)


def count(samples: Iterable[str | None]) -> dict[str, Counter]:
    """By script, the bigrams of its words, '^' before each word, lower case; under '' the words. Counts of parts of the samples add up to those of all."""
    find = re.compile(f"(?:[^\\W\\d_]|[{_MARKS}])+").findall
    counts: dict[str, Counter] = {s: Counter() for s in SCRIPTS}
    words: Counter[str] = Counter()

    def settle() -> None:
        for word, n in words.items():
            kinds = {s for c in word if (s := script_of(c))}
            if len(kinds) == 1:
                bare = "^" + "".join(c for c in word if not unicodedata.combining(c))
                own = counts[kinds.pop()]
                own[""] += n
                for a, b in zip(bare, bare[1:]):
                    own[a + b] += n
        words.clear()

    for text in samples:
        words.update(find(unicodedata.normalize("NFD", text or "").lower()))
        if len(words) >= REMEMBERED:
            settle()
    settle()
    return counts


def fit(samples: Iterable[str | None], skeletons: dict[str, str]) -> Model:
    """The model of samples at hand."""
    return fit_counts(count(samples), skeletons)


def fit_counts(counts: dict[str, Counter], skeletons: dict[str, str]) -> Model:
    """Logarithms of add-one bigram shares by script, and of the scripts' shares of words."""
    out = {}
    for s in SCRIPTS:
        after = Counter()
        for pair, n in counts[s].items():
            after[pair[:1]] += n
        out[s] = {pair: math.log((n + 1) / (after[pair[0]] + 40)) for pair, n in counts[s].items() if pair}
    total = sum(counts[s][""] for s in SCRIPTS)
    return Model(shapes(skeletons), out, {s: math.log((counts[s][""] + 1) / (total + len(SCRIPTS))) for s in SCRIPTS})


def model(lang_samples: DataFrame) -> Model:
    """The model, fitted on every labelled sample that has a text.

    Tasks count their samples; only sums by script and bigram are shuffled and reach the
    driver, whose number follows from the letters in use and not from the samples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = count(x for b in batches for x in b.column(0).to_pylist())
        rows = [(s, pair, n) for s, own in counts.items() for pair, n in own.items()]
        for at in range(0, len(rows), REMEMBERED):
            scripts, pairs, numbers = zip(*rows[at : at + REMEMBERED])
            yield pa.RecordBatch.from_arrays([pa.array(scripts, pa.string()), pa.array(pairs, pa.string()), pa.array(numbers, pa.int64())], names=["script", "pair", "n"])

    parts = lang_samples.filter(F.col("text").isNotNull()).select("text").mapInArrow(run, "script string, pair string, n bigint")
    counts: dict[str, Counter] = {s: Counter() for s in SCRIPTS}
    for script, pair, n in parts.groupBy("script", "pair").agg(F.sum("n")).toLocalIterator():
        counts[script][pair] = n
    return fit_counts(counts, confusables(lang_samples.sparkSession))


def normalize(df: DataFrame, keys: list[str], text: str, fitted: Model) -> DataFrame:
    """``*keys, text`` with the text in its one form: a narrow map that reads only these columns."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(fitted)
        for b in batches:
            done = [None if x is None else reader.normal(x) for x in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(done, pa.string())], names=[*keys, "text"])

    return df.select(*keys, F.col(text)).mapInArrow(run, schema)


def forms_of(df: DataFrame, fitted: Model, table: str, key: str, text: str) -> DataFrame:
    """``tbl, id, stored, form``: digests of the text of each row, as stored and in its one form; a key stored twice is one row."""
    stored = df.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).withColumn("stored", F.unhex(F.md5(text)))
    forms = normalize(stored, [table, key, "stored"], text, fitted).select(table, key, "stored", F.unhex(F.md5("text")).alias("form"))
    return cut_lineage(forms.groupBy(table, key).agg(F.min("stored").alias("stored"), F.min("form").alias("form")))  # several branches read it


def look_classes(df: DataFrame, fitted: Model, table: str = "tbl", key: str = "id", text: str = "text") -> DataFrame:
    """``tbl, id, class, others``: every row that looks the same as one of other characters, once, with the least id of its look and the number of such rows; no pairs."""
    rows = forms_of(df, fitted, table, key, text)
    texts = rows.groupBy(table, "form", "stored").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least"))
    looks = texts.groupBy(table, "form").agg(F.sum("n").alias("all"), F.min("least").alias("class"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    counted = texts.join(looks, [table, "form"]).select(table, "form", "stored", "class", (F.col("all") - F.col("n")).alias("others"))
    return rows.join(counted, [table, "form", "stored"]).select(table, key, "class", "others")


def same_looking(df: DataFrame, fitted: Model, table: str = "tbl", key: str = "id", text: str = "text") -> DataFrame:
    """``tbl, id_a, id_b`` of rows of one table that look the same though their characters differ.

    Only digests are shuffled; groups of a single stored text end at the aggregation.
    Rows without text or key are in no pair; a key stored twice is one row.
    """
    rows = forms_of(df, fitted, table, key, text)
    several = rows.groupBy(table, "form").agg(F.min("stored").alias("x"), F.max("stored").alias("y")).filter("x <> y").select(table, "form")
    held = rows.join(several, [table, "form"])
    a = held.select(table, "form", F.col(key).alias("id_a"), F.col("stored").alias("stored_a"))
    b = held.select(table, "form", F.col(key).alias("id_b"), F.col("stored").alias("stored_b"))
    return a.join(b, [table, "form"]).filter("id_a < id_b AND stored_a <> stored_b").select(table, "id_a", "id_b")
