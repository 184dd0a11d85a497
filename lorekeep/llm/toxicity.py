"""Toxicity by noisy-channel deobfuscation.

1. A character language model (trigrams over letters and word ends) is counted over the words of all documents.
2. Tokens that hide letters (digits and signs for letters, doubled or stretched letters, signs or white space
   between letters) become a lattice: per run of equal characters the letters it may stand for, each with a channel cost.
   Viterbi decoding under the language model gives the likeliest word, which joins the plain parts of the token.
3. The restored words, and their beginnings of 4 to 6 letters for inflected forms, are counted in labelled documents;
   those that stand out in toxic ones carry a lower bound of their log-odds as evidence. A logistic curve over the
   logarithms of a document's evidence and of its number of distinct tokens, fitted on the same rows, gives the score.

Labels are learned from at most SAMPLE_PER_CLASS rows of each class, those with the smallest hash of their id; this
sample alone is broadcast. The model that tasks receive is bounded too: the trigram table by the alphabet, the lexicon
by MAX_FEATURES strongest features. Counting and scoring read every whole text.

Defined cases: null and empty texts have no evidence and get the score of a text without any; repeated rows are scored
each; labels that are null are ignored, a document labelled both ways counts as toxic; without labels of both
classes every score is the share of toxic labels (0 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.worker import forget, trim

SAMPLE_PER_CLASS = 10_000
MAX_FEATURES = 20_000
MIN_DOCUMENTS = 4
MIN_LOG_ODDS = 2.5
DEVIATIONS = 1.25
REMEMBERED = 150_000

# Letters the language model tells apart, after lower-casing; the rest of the letters is one class.
ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
END, OTHER = 0, len(ALPHABET) + 1
CODES = len(ALPHABET) + 2
STATES = CODES**2
CODE = {c: k for k, c in enumerate(ALPHABET, 1)}

# What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¥": "y", "(": "c", "<": "c", "#": "h", "*": "aeiou",
}
# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіѕјԁɡοαεικντυ", "aeopcyxisjdgoaeikvtu")
SEPARATORS = frozenset(".-_*~'’·•,/\\:;|")
SIGN_COST, REPEAT_COST, DROP_COST = 1.0, 0.7, 0.3

PART_CHARS = 64  # longer tokens are decoded part by part
OUTER_OPEN, OUTER_CLOSE = "([{<\"'“‘«*_~", ")]}>\"'”’»*_~.,;:?!"
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}[.,;:?!]*(?!\S)")
STRETCHED = re.compile(r"(.)\1\1")
PARTED = re.compile(r"[.\-_~'’·•,/\\:;|]+")
WORDS = re.compile(r"[^\W\d_]+")


def codes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return TABLE[np.minimum(points, len(TABLE) - 1)]


def code_table() -> np.ndarray:
    table = np.array([OTHER if chr(p).isalpha() else END for p in range(0x250)], dtype=np.uint32)
    table[-1] = OTHER  # also for all later code points
    for c, k in CODE.items():
        table[ord(c)] = k
    return table


TABLE = code_table()


CHUNK_CHARS = 1_000_000


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of all trigrams of a task's texts; a row per trigram that occurs."""
    total = np.zeros(CODES**3, dtype=np.int64)
    forget("encoders", "powers")

    def add(texts: list[str]) -> None:
        c = codes_of("  " + "  ".join(texts) + "  ").astype(np.int32)
        np.add(total, np.bincount(c[:-2] * CODES**2 + c[1:-1] * CODES + c[2:], minlength=CODES**3), out=total)

    for batch in batches:
        held, chars = [], 0
        for text in batch.columns[0].to_pylist():
            if text:
                held.append(text)
                chars += len(text)
            if chars > CHUNK_CHARS:
                add(held)
                held, chars = [], 0
        if held:
            add(held)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["trigram", "n"])


class Language:
    """log P(c | a, b) by interpolated trigrams."""

    def __init__(self, counts: dict[int, int]):
        tri = np.zeros(CODES**3)
        tri[list(counts)] = list(counts.values())
        tri = tri.reshape(CODES, CODES, CODES)
        bi, one = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + CODES)
        p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
        self.log_p = np.log(p3).astype(np.float32)


def options(char: str, times: int) -> list[tuple[str, float]]:
    """What a run of one character may stand for, with its channel cost."""
    found = []
    if char.isalpha():
        found = [(char, 0.0 if times == 1 else REPEAT_COST), (char * 2, 0.0 if times == 2 else REPEAT_COST * (1 + (times == 1) * 9))]
        found = found[: 1 + (times > 1)]
    for letter in LEET.get(char, ""):
        cost = SIGN_COST + (1.0 if char == "*" else 0.0)
        found.append((letter, cost + REPEAT_COST * (times > 1)))
        if times > 1:
            found.append((letter * 2, cost))
    if char in SEPARATORS or char == " ":
        found.append(("", DROP_COST))
    return found or [("", 4.0)]


class Channel:
    """A language model as plain numbers, which are read faster one by one, and the options of runs with their codes."""

    def __init__(self, log_p: np.ndarray):
        self.log_p = log_p.ravel().tolist()
        self.options = Remembered(coded_options, 10_000)


def coded_options(run: str) -> list[tuple[str, list[int], float]]:
    """(letters, their codes, cost) of a run; longer ones than three characters have the options of three."""
    return [(letters, [CODE.get(c, OTHER) for c in letters], cost) for letters, cost in options(run[0], len(run))]


def channel_of(log_p: np.ndarray | Channel) -> Channel:
    return log_p if isinstance(log_p, Channel) else Channel(log_p)


def decode(token: str, log_p: np.ndarray | Channel) -> str:
    """The likeliest word behind a token: Viterbi over its lattice, states are the last two letters (as one number)."""
    channel = channel_of(log_p)
    log_p, runs = channel.log_p, channel.options
    states: dict[int, tuple[float, str]] = {}
    one, total, at, size = END * CODES + END, 0.0, 0, len(token)
    path: list[str] = []
    while at < size:
        char, end = token[at], at + 1
        while end < size and token[end] == char:
            end += 1
        found = runs[token[at : min(end, at + 3)]]
        if not states:
            if len(found) == 1:  # one path up to the first choice
                letters, codes, cost = found[0]
                total -= cost
                for k in codes:
                    step = one * CODES + k
                    total += log_p[step]
                    one = step % STATES
                path.append(letters)
                at = end
                continue
            states = {one: (total, "".join(path))}
        onward: dict[int, tuple[float, str]] = {}
        for letters, codes, cost in found:
            for state, (score, word) in states.items():
                s = score - cost
                for k in codes:
                    step = state * CODES + k
                    s += log_p[step]
                    state = step % STATES
                best = onward.get(state)
                if best is None or s > best[0]:
                    onward[state] = (s, word + letters)
        states, at = onward, end
    return max((score + log_p[state * CODES + END], word) for state, (score, word) in states.items())[1] if states else "".join(path)


def lowered(token: str) -> str:
    low = token.lower()
    return low if low.isascii() else low.translate(LOOKALIKES)


def body_of(token: str) -> str:
    return lowered(token).lstrip(OUTER_OPEN).rstrip(OUTER_CLOSE)


def doubled(body: str) -> bool:
    """Do two equal characters follow each other."""
    return True in map(eq, body, body[1:])


def whole(body: str, log_p: np.ndarray | Channel) -> str:
    return "".join(decode(body[k : k + PART_CHARS], log_p) for k in range(0, len(body), PART_CHARS))


def address(body: str) -> bool:
    return "@" in body[1:-1] and "." in body.partition("@")[2]


def words_of(token: str, log_p: np.ndarray | Channel) -> tuple[str, ...]:
    """Plain words of a token and, where it may hide letters, the restored ones: its parts between separators, and all of it
    as one word, since separators may stand between letters too."""
    # A token of signs alone may begin or end with some that stand for letters.
    if token.isalpha():
        body = lowered(token)
    else:
        body = body_of(token) if WORDS.search(token) else token.lower()
    if not body or body.isalpha() and not doubled(body):
        return (body,) if body else ()
    plain = tuple(WORDS.findall(body))
    if address(body):
        return plain
    parts = [p for p in PARTED.split(body) if p and p != body and not (p.isalpha() and not doubled(p))]
    log_p = channel_of(log_p)
    restored = [whole(p, log_p) for p in (*parts, body)]
    return (*plain, *dict.fromkeys(w for w in restored if w and w not in plain))


def tokens_of(text: str) -> set[str]:
    """Distinct tokens, with runs of single characters joined to one."""
    words = text.split()
    found = set(words)
    if b"\1\1" not in bytes(map((1).__eq__, map(len, words))):  # SPACED begins with two words of one character
        return found
    for m in SPACED.finditer(text):
        joined = "".join(m[0].split())
        if not joined.isdigit():
            found.update((joined, joined[1:]))  # the first may be a word of one letter
    return found


def restored_text(text: str | None, log_p: np.ndarray | Channel) -> str | None:
    """The text with every token that hides letters replaced by its restored word."""
    if not text:
        return text

    log_p = channel_of(log_p)

    def restored(m: re.Match) -> str:
        body = body_of(m[0])
        words = WORDS.findall(body)
        # Numbers and words with double letters mostly are what they seem to be; the score looks behind them too.
        if words and not address(body) and (not body.isalpha() or STRETCHED.search(body)):
            words = [w for w in (words[-1], whole(body, log_p)) if w not in words[:-1]] or words
        return words[-1] if words and words[-1] not in m[0].lower() else m[0]

    joined = SPACED.sub(lambda m: "".join(m[0].split()), text)
    return re.sub(r"\S+", restored, joined)


def features_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in (4, 5, 6) if len(word) > n]] if len(word) > 2 else []


@dataclass
class Model:
    log_p: np.ndarray
    lexicon: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, float, float] = (-math.inf, 0.0, 0.0)

    @cached_property
    def channel(self) -> Channel:
        return Channel(self.log_p)

    @cached_property
    def heads(self) -> set[str]:
        """How the features of ``lexicon`` begin; all features of a word begin like the word."""
        return {f[:4] for f in self.lexicon}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("channel", "heads")}

    def evidence_of_token(self, token: str) -> float:
        heads = self.heads
        odds = [self.lexicon[f] for w in words_of(token, self.channel) if w[:4] in heads for f in features_of(w) if f in self.lexicon]
        return max(odds, default=0.0)

    def score(self, evidence: float, tokens: int) -> float:
        base, slope, length = self.weights
        z = base + slope * math.log1p(evidence) + length * math.log1p(tokens)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


class Remembered(dict):
    """A function's results by argument, started anew when full."""

    def __init__(self, function: Callable, most: int = REMEMBERED):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value


def evidence(text: str | None, of: Remembered) -> tuple[float, int]:
    """Sum over the text's distinct tokens, and their number."""
    tokens = tokens_of(text) if text else ()
    return math.fsum(map(of.__getitem__, tokens)), len(tokens)


def language(docs: DataFrame, text_col: str = "text") -> Language:
    counts = docs.select(text_col).mapInArrow(count_trigrams, "trigram bigint, n bigint").groupBy("trigram").agg(F.sum("n").alias("n"))
    return Language({r["trigram"]: r["n"] for r in counts.collect()})  # at most CODES ** 3 rows


def labelled_sample(labels: DataFrame, allowed: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic) with at most ``per_class`` rows of each class, and how many rows each class has."""
    known = labels.where(allowed & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = (F.xxhash64("doc_id", F.lit("sample")), F.col("doc_id"))
    one, two = (known.where(F.col("toxic") == k).orderBy(*order).limit(per_class) for k in (0, 1))
    rows = [(r["doc_id"], r["toxic"]) for r in one.unionByName(two).collect()]
    return labels.sparkSession.createDataFrame(rows, "doc_id bigint, toxic int"), sizes


def counted_features(log_p: np.ndarray) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(log_p)
        of = Remembered(lambda token: tuple(f for w in words_of(token, channel) for f in features_of(w)), REMEMBERED // 5)
        for batch in batches:
            sums = (Counter(), Counter())
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                sums[toxic].update({f for token in tokens_of(text or "") for f in of[token]})
            names = list(sums[0] | sums[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *[pa.array([s[f] for f in names], pa.int64()) for s in sums]], ["feature", "clean", "toxic"]
            )

    return count


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression of y on the columns of x, with a little ridge, by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - 1e-3 * w
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step / max(1.0, np.abs(step).max() / 2)
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), using only label rows that are ``allowed``."""
    model = Model(language(docs).log_p)
    sample, sizes = labelled_sample(labels, F.lit(True) if allowed is None else allowed, per_class)
    total = sum(sizes.values())
    if not sizes.get(0) or not sizes.get(1):
        share = sizes.get(1, 0) / total if total else 0.0
        model.weights = (math.log(share / (1 - share)) if 0 < share < 1 else math.inf if share else -math.inf, 0.0, 0.0)
        return model
    # Only the ids are broadcast: at most 2 * per_class rows.
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    # Copies of one text are one observation.
    known = known.groupBy(F.sha2("text", 256), "toxic").agg(F.first("text").alias("text")).select("text", "toxic")
    used = {k: 0 for k in (0, 1)} | {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    counts = known.mapInArrow(counted_features(model.log_p), "feature string, clean bigint, toxic bigint")
    counts = counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (used[1] + 1)) - F.log((F.col("clean") + 0.5) / (used[0] + 1))
    odds -= DEVIATIONS * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    strong = counts.where(F.col("toxic") >= MIN_DOCUMENTS).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
    chosen = strong.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "feature").limit(MAX_FEATURES)
    model.lexicon = {r["feature"]: r["odds"] for r in chosen.collect()}
    rows = known.mapInArrow(evidence_rows(model), "evidence double, tokens int, toxic int").collect()  # the sample's rows
    x, y = np.log1p([(r["evidence"], r["tokens"]) for r in rows]), np.array([r["toxic"] for r in rows], dtype=float)
    share = [sizes[k] / max(1, (y == k).sum()) for k in (0, 1)]
    model.weights = fit_curve(x, y, np.where(y > 0, share[1], share[0]) * len(y) / total)
    return model


def evidence_rows(model: Model) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("encoders", "powers")
        of = Remembered(model.evidence_of_token)
        for batch in batches:
            found = [evidence(t, of) for t in batch.columns[0].to_pylist()]
            sums, tokens = zip(*found) if found else ((), ())
            arrays = [pa.array(sums, pa.float64()), pa.array(tokens, pa.int32()), batch.columns[1]]
            yield pa.RecordBatch.from_arrays(arrays, ["evidence", "tokens", "toxic"])

    return find


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in ``score_col``; a column of that name is replaced."""

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget("encoders", "powers")
        known = Remembered(model.evidence_of_token)
        for batch in texts:
            yield batch.map(lambda t: model.score(*evidence(t, known)))
        known.clear()
        trim()

    return docs.withColumn(score_col, of(F.coalesce(F.col(text_col), F.lit(""))))


def restore(docs: DataFrame, model: Model, text_col: str = "text", restored_col: str = "restored") -> DataFrame:
    """``docs`` with the deobfuscated text in ``restored_col``."""
    @F.pandas_udf("string")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: restored_text(t, model.channel), na_action="ignore")

    return docs.withColumn(restored_col, of(F.col(text_col)))
