"""Languages of documents and of their segments, by multilingual mixture inference.

Each word has a likelihood in each language from character n-grams (orders 1 to 4,
interpolated) of labelled samples. A word's likelihood is mixed with that of a word
of no language, so names, numbers and code, which look alike in all languages, weigh
little. Expectation-maximisation over a document's lines estimates its language
proportions; the language set is chosen by penalised likelihood (``PRICE`` for every
language more). Segments follow from the most likely path of the lines through the
set, with ``CHANGE`` as the price of changing; lines that say nothing join their
neighbours. Segment confidence is the posterior of its language in the set's mixture.

Results: null, empty and blank contents, and texts without letters, have no language
(no segment); a content of one language is one segment; repeated ids are one content.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm import lookalikes

ORDER = 4
PRICE = 14.0
CHANGE = 9.0
#: Share of words that are of no language.
NEUTRAL = 0.25
#: Words a worker remembers; the memory is emptied when full, which changes no result.
REMEMBERED = 200_000
#: Labelled samples the fit reads at most (the documented bound of the fit).
SAMPLES = 10_000

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)")
_TAGS = re.compile(r"<[^<>]*>|\]\([^()\s]*\)|https?://\S+|&#?\w+;|\\\w+|\{\{[^{}]*\}\}|`[^`\n]*`")

_RETURNS = re.compile("[\r\x0b\x0c\x85\u2028\u2029]")
_MARKS = re.compile(r"[<\\`&]|\]\(|\{\{|://")

#: Names of languages, besides codes with regions.
NAMES = """
en eng english
de deu ger german deutsch
fr fra fre french français francais
es spa spanish español espanol castellano
it ita italian italiano
pt por portuguese português portugues
nl nld dut dutch nederlands flemish
pl pol polish polski
ru rus russian русский
zh zho chi chinese 中文
"""


def label_code(label: Column) -> Column:
    """The two-letter code a label names, in any notation; null if it names no language known here."""
    pairs = [(word, line.split()[0]) for line in NAMES.strip().splitlines() for word in line.split()]
    names = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    base = F.element_at(F.split(F.lower(F.trim(label)), r"[-_.@ ;,(/]"), 1)
    return F.element_at(names, base)


class Model:
    """Word likelihoods by language."""

    def __init__(self, samples: list[tuple[str, str]], looks: lookalikes.Model | None = None):
        self.languages = sorted({lang for lang, _ in samples})
        self.index = {x: i for i, x in enumerate(self.languages)}
        self.looks = looks or lookalikes.fit([text for _, text in samples], {})
        n = len(self.languages)
        self.grams: dict[str, np.ndarray] = {}
        self.words: dict[str, np.ndarray] = {}
        counts: dict[str, Counter] = {x: Counter() for x in self.languages}
        words: dict[str, Counter] = {x: Counter() for x in self.languages}
        for lang, text in samples:
            for w in _WORD.findall(text.lower()):
                words[lang][w] += 1
                p = f"^{w}$"
                for o in range(1, ORDER + 1):
                    counts[lang].update(p[i : i + o] for i in range(len(p) - o + 1))
        for lang, c in counts.items():
            for g, k in c.items():
                self.grams.setdefault(g, np.zeros(n))[self.index[lang]] = k
        for lang, c in words.items():
            for w, k in c.items():
                self.words.setdefault(w, np.zeros(n))[self.index[lang]] = k
        self.total = sum((v for g, v in self.grams.items() if len(g) == 1), np.zeros(n))
        self.n_words = sum(self.words.values(), np.zeros(n))
        self.alphabet = sum(len(g) == 1 for g in self.grams) + 1

    def gram(self, g: str) -> np.ndarray:
        """Share of the last letter after the others, in each language: each order leans on the one below."""
        below = np.full(len(self.languages), 1.0 / (self.alphabet + 1)) if len(g) == 1 else self.gram(g[1:])
        seen = self.grams.get(g)
        context = self.total if len(g) == 1 else self.grams.get(g[:-1])
        if context is None:
            return below
        weight = 3.0
        return ((0 if seen is None else seen) + weight * below) / (context + weight)

    def word(self, w: str) -> np.ndarray:
        """Logarithms of the word's likelihood in each language, against a word of no language; 0 says nothing."""
        p = f"^{w}$"
        spelled = np.zeros(len(self.languages))
        for i in range(1, len(p)):
            spelled += np.log(self.gram(p[max(0, i - ORDER + 1) : i + 1]))
        known = self.words.get(w)
        like = 0.5 * np.exp(spelled) + 0.5 * (known / self.n_words if known is not None else 0)
        neutral = like.mean() + 1e-12
        return np.log((1 - NEUTRAL) * like / neutral + NEUTRAL)


class Reader:
    """Reads contents with one model, remembering words."""

    def __init__(self, model: Model):
        self.model = model
        self.looks = lookalikes.Reader(model.looks)
        self.memory: dict[str, int] = {}
        self.known = np.zeros((4096, len(model.languages)))

    def place(self, w: str) -> int:
        """The row of ``known`` that has the word's likelihoods."""
        at = len(self.memory)
        if at == len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        self.known[at] = self.model.word(w)
        self.memory[w] = at
        return at

    def lines(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Per line: log-likelihoods by language, and letters."""
        if len(self.memory) >= REMEMBERED:
            self.memory.clear()
        text = self.looks.readable(_RETURNS.sub("", text))  # a letter of another script that looks the same is no sign of a language
        memory, place = self.memory, self.place
        rows, ends, letters, code = [], [], [], False
        for line in text.lower().split("\n"):
            if ("``" in line or "~~" in line) and _FENCE.match(line):
                code = not code
                line = ""
            if code:
                line = ""
            elif _MARKS.search(line):
                line = _TAGS.sub(" ", line)
            n = 0
            for w in _WORD.findall(line):
                at = memory.get(w)
                rows.append(place(w) if at is None else at)
                n += len(w)
            ends.append(len(rows))
            letters.append(n)
        total = np.concatenate([np.zeros((1, self.known.shape[1])), np.cumsum(self.known[rows], axis=0)]) if rows else np.zeros((1, self.known.shape[1]))
        ends = np.array(ends)
        return total[ends] - total[np.concatenate([[0], ends[:-1]])], np.array(letters)

    def mixture(self, scores: np.ndarray, chosen: list[int]) -> tuple[float, np.ndarray]:
        """Log-likelihood and proportions of a set of languages, by expectation-maximisation."""
        own = scores[:, chosen]
        top = own.max(axis=1, keepdims=True)
        like = np.exp(own - top)
        share = np.full(len(chosen), 1.0 / len(chosen))
        for _ in range(12 if len(chosen) > 1 else 0):
            r = like * share
            r /= r.sum(axis=1, keepdims=True)
            new = r.mean(axis=0) + 1e-6
            new /= new.sum()
            if np.abs(new - share).max() < 1e-4:
                break
            share = new
        return float((np.log(like @ share) + top[:, 0]).sum()), share

    def read(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """Segments: language, confidence, first and last line (from 1), letters."""
        scores, letters = self.lines(text)
        telling = np.flatnonzero(np.abs(scores).max(axis=1) > 1e-9)
        if not len(telling):
            return []
        own = scores[telling]
        total = own.sum(axis=0)
        chosen = [int(total.argmax())]
        value, _ = self.mixture(own, chosen)
        rest = own.max(axis=1) - own[:, chosen[0]]
        while len(chosen) < own.shape[1] and np.maximum(rest, 0).sum() > PRICE:
            gains = np.maximum(own - own[:, chosen].max(axis=1, keepdims=True), 0).sum(axis=0)
            best = None
            for c in [int(c) for c in np.argsort(-gains) if gains[c] > PRICE and c not in chosen]:
                v, _ = self.mixture(own, [*chosen, c])
                if v - PRICE > value and (best is None or v > best[0]):
                    best = (v, c)
            if best is None:
                break
            value = best[0] - PRICE
            chosen.append(best[1])
        _, share = self.mixture(own, chosen)
        path = self.path(own[:, chosen], np.log(share)) if len(chosen) > 1 else np.zeros(len(own), int)
        out, at = [], 0
        lang = self.model.languages
        runs = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        others = np.arange(own.shape[1])
        for a, b in zip(runs, runs[1:]):
            c = chosen[path[a]]
            s = own[a:b].sum(axis=0)
            confidence = 1 / (1 + np.exp(np.clip(s[others != c] - s[c], -700, 50)).sum())
            last = len(scores) if b == len(path) else int(telling[b])
            out.append((lang[c], float(confidence), at + 1, last, int(letters[at:last].sum())))
            at = last
        return out

    def path(self, own: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """The most likely languages of the lines."""
        best, back = prior + own[0], []
        for s in own[1:]:
            stay_or_come = best.max() - CHANGE
            came = best.argmax()
            back.append(np.where(best >= stay_or_come, np.arange(len(best)), came))
            best = np.maximum(best, stay_or_come) + s
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return np.array(out[::-1])


def fit(lang_samples: DataFrame, most: int = SAMPLES) -> Model:
    """The model of at most ``most`` labelled samples."""
    rows = lang_samples.filter("text IS NOT NULL AND lang IS NOT NULL").orderBy("sample_id").select("lang", "text").limit(most).collect()
    return Model([(r.lang, r.text) for r in rows], lookalikes.fit([r.text for r in rows], lookalikes.confusables(lang_samples.sparkSession)))


def segments(df: DataFrame, fitted: Model, keys: list[str], text: str = "content") -> DataFrame:
    """``*keys, segments`` (language, confidence, first and last line, letters) of each row: a narrow map."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(fitted)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("letters", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        names = ["lang", "confidence", "first_line", "last_line", "letters"]
        for b in batches:
            done = [[] if x is None else [dict(zip(names, s)) for s in reader.read(x)] for x in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(done, kind)], names=[*keys, "segments"])

    return df.select(*keys, F.col(text)).mapInArrow(run, f"{schema}, segments array<struct<lang string, confidence double, first_line int, last_line int, letters int>>")


def wrong_or_mixed(read: DataFrame, key: str = "content_id", label: str = "lang") -> DataFrame:
    """``key, seg_no, lang``: segment 0 for a content of one language whose label names another or none; every segment of a mixed one."""
    several = F.size("segments") > 1
    first = F.col("segments")[0]["lang"]
    wrong = (F.size("segments") == 1) & ~F.coalesce(label_code(F.col(label)) == first, F.lit(False))
    case = F.when(several, F.transform("segments", lambda s, i: F.struct((i + 1).alias("seg_no"), s["lang"].alias("lang")))).when(wrong, F.array(F.struct(F.lit(0).alias("seg_no"), first.alias("lang"))))
    return read.select(key, F.explode(case).alias("x")).select(key, "x.seg_no", "x.lang").distinct()
