"""Threshold decision over an AI-text score, with a pluggable scorer.

A scorer is a callable from a list of texts to probabilities in [0, 1]; it is made
once per worker process by the factory given. The built-in ``baseline`` is a plain
statistic of word variety and sentence evenness: it is no model of the reference
behaviour and claims no agreement with any. Scores are float32, widened afterwards.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DETECTOR = "papyrine-baseline"
VERSION = "1"
THRESHOLD = 0.95
SCHEMA = "struct<score double, error string>"

#: How failures are told; a scorer that raises ``PredictionError`` failed on a text, any other error is a crash.
PREDICTION_FAILED = "slop detector prediction failed: "
UNAVAILABLE = "slop detector unavailable: upstream detector panicked while loading the model or predicting: "

Scorer = Callable[[Sequence[str]], Sequence[float]]
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?。]+\s*")


class PredictionError(Exception):
    """Raised by a scorer that cannot score a text."""


def failure(e: BaseException) -> str:
    return PREDICTION_FAILED + str(e) if isinstance(e, PredictionError) else UNAVAILABLE + (str(e) or "unknown panic")


def scored(texts: list[str], scorer: Callable[[], Scorer], made: dict[str, Scorer]) -> list[dict]:
    """Score or error of each text: one call for all, and one for each text only if that fails."""
    one = lambda x: {"score": float(np.float32(x)), "error": None}
    try:
        model = made.get("it") or made.setdefault("it", scorer())
    except Exception as e:  # noqa: BLE001
        return [{"score": None, "error": failure(e)} for _ in texts]
    try:
        return [one(x) for _, x in zip(texts, model(texts), strict=True)]
    except Exception:  # noqa: BLE001
        out = []
        for t in texts:
            try:
                out.append(one(model([t])[0]))
            except Exception as e:  # noqa: BLE001
                out.append({"score": None, "error": failure(e)})
        return out


def baseline() -> Scorer:
    """Even sentences of repeated words score high."""

    def score(texts: Sequence[str]) -> list[float]:
        out = []
        for t in texts:
            words = _WORD.findall(t.lower())
            lengths = [len(_WORD.findall(s)) for s in _SENTENCE.split(t) if s.strip()]
            if not words or not lengths:
                out.append(0.0)
                continue
            mean = sum(lengths) / len(lengths)
            spread = math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths)) / max(mean, 1e-9)
            variety = len(set(words)) / len(words)
            out.append(1 / (1 + math.exp(4 * (spread + variety - 1))))
        return out

    return score


def check_threshold(threshold: float) -> float:
    if not (isinstance(threshold, (int, float)) and math.isfinite(threshold) and 0 <= threshold <= 1):
        raise ValueError("confidenceThreshold must be between 0.0 and 1.0")
    return float(np.float32(threshold))


def detect_ai_generated_text(text: Column, threshold: float = THRESHOLD, scorer: Callable[[], Scorer] = baseline, detector: str = DETECTOR, version: str = VERSION) -> Column:
    """``struct<flagged, confidence_score, confidence_threshold, classification, detector, detector_model_version, error>``.

    Null text gives a null struct; a scorer that fails gives nulls and its message in ``error``. The scorer reads a whole Arrow batch at once.
    """
    limit = check_threshold(threshold)
    made: dict[str, Scorer] = {}

    @F.arrow_udf(SCHEMA)
    def run(v: pa.Array) -> pa.Array:
        texts = v.to_pylist()
        known = [x for x in texts if x is not None]
        done = iter(scored(known, scorer, made) if known else [])
        return pa.array([None if x is None else next(done) for x in texts], pa.struct([("score", pa.float64()), ("error", pa.string())]))

    got = run(text)
    score = got["score"]
    flagged = score >= F.lit(limit)
    return F.when(
        text.isNotNull(),
        F.struct(
            flagged.alias("flagged"),
            score.alias("confidence_score"),
            F.lit(limit).alias("confidence_threshold"),
            F.when(flagged, "ai").when(~flagged, "human").alias("classification"),
            F.lit(detector).alias("detector"),
            F.lit(version).alias("detector_model_version"),
            got["error"].alias("error"),
        ),
    )
