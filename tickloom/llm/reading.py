"""Reading level of documents from the grades at which their words are acquired.

From texts that readers have judged, each word gets the grade at which it turns up: the expected
band of a text that holds it, bands counting alike. The same is done for the build of sentences,
whose length and subclauses enter as words of their own kind. A document is described by quantiles
of the grades of its known words, and a model calibrated on the judged texts turns these into a band.
Only running English prose is read: tables, logs, code and other languages are left aside line by line.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANDS = ["basic", "intermediate", "advanced"]
#: Words of prose that make a document a case, and the most judged documents the model is fitted on.
LEAST_WORDS = 40
SAMPLE_DOCS = 2_000
QUANTILES = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]

# Function words of English, and of the languages that English is told from.
ENGLISH = frozenset(
    "a about after all an and another any are as at be because been before both but by can could did do does each for from had has have how if in into is it its more most "
    "no nor not of off on one only or other our out over same several she should since so some such than that the their them then there these they this those through to "
    "too under until up upon very was we were what when where whereas whether which while who will with would you your".split()
)
FOREIGN = frozenset(
    "der die das den dem des ein eine einen einer und oder nicht ist sind war wird mit von zu zum zur im auf aus bei nach vor ohne dass weil obwohl wenn "
    "le la les un une des du de et ou est sont pas ne que qui dans pour par sur avec avant sans même déjà "
    "el los las una uno y o es son no que en por para con sin del al antes después porque aunque cada".split()
) - frozenset("a no o y as an in on is do me".split())

_word = regex.compile(r"\p{Latin}+(?:['’\-‐]\p{Latin}+)*")
_odd = regex.compile(r"[=\[\]{}<>|_\\@^~]|\w\(|0x")
_number = regex.compile(r"[+\-±]?\d[\d.,:]*%?")
_end = regex.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(]*\p{Lu}|[-*•]\s)")
_STRIP = ".,;:!?()\"'’“”…*#-–—•"


@lru_cache(maxsize=200_000)
def _judged_token(tok: str) -> tuple[str | None, int, int, float]:
    """A token's word ('' for a number, None for neither), its weight against prose, and how English and how foreign it is."""
    core = tok.strip(_STRIP)
    if not core:
        return None, 0, 0, 0.0
    if _word.fullmatch(core):
        w = core.lower()
        return w, 0, int(w in ENGLISH), (w in FOREIGN and w not in ENGLISH) + 0.5 * (not w.isascii())
    odd = _odd.search(tok)
    if _number.fullmatch(core) and not odd:
        return "", 0, 0, 0.0
    return None, 2 if odd else 1, 0, 0.0


def prose_lines(text: str) -> list[tuple[int, str, list[str]]]:
    """The lines of running English prose: number, text, and words in lower case, '' standing for a number.

    A line counts when at least three quarters of it are words (signs of code or tables weigh
    double against it), and when English function words outweigh those of other languages, in the
    line or, where it has neither, in all such lines of the document.
    """
    lines = []
    english = foreign = 0
    for no, raw in enumerate(text.splitlines()):
        words, numbers, other, e, f = [], 0, 0, 0, 0.0
        for tok in raw.split():
            # tokens recur; long ones do not, and are not kept
            word, odd, en, fo = _judged_token(tok) if len(tok) <= 40 else _judged_token.__wrapped__(tok)
            if word is not None:
                words.append(word)
                numbers += not word
                e += en
                f += fo
            else:
                other += odd
        n = len(words) - numbers
        if n < 2 or n < 0.75 * (n + numbers + other):
            continue
        english, foreign = english + e, foreign + f
        lines.append(((no, raw, words), e, f, n))
    total = sum(n for *_, n in lines)
    if english <= 2 * foreign or english < 0.05 * total:
        # the document as a whole is not English: only lines that clearly are
        return [w for w, e, f, n in lines if e > 2 * f and e >= 0.15 * n and n >= 5]
    # a long line in which foreign function words are as common as English ones is pasted from another language
    return [w for w, e, f, n in lines if f < 0.1 * n or 2 * f <= e or (n < 12 and f <= e)]


def sentences(text: str) -> list[str]:
    return [s for s in _end.split(text) if s.strip()]


def _bucket(n: int, steps: tuple[int, ...]) -> int:
    return sum(n > s for s in steps)


def describe(text: str | None) -> tuple[int, Counter, Counter]:
    """Number of words of prose, its words, and the build of its sentences."""
    if not text or text.isspace():
        return 0, Counter(), Counter()
    kept = prose_lines(text)
    words: Counter = Counter()
    build: Counter = Counter()
    # lines of a paragraph belong together unless they are items of a list
    prose: list[str] = []
    before = None
    for no, raw, ws in kept:
        words.update(ws)
        line = raw.strip()
        if before == no - 1 and line[:1] not in "-*•" and not prose[-1].endswith((".", "!", "?", ":")):
            prose[-1] += " " + line
        else:
            prose.append(line)
        before = no
    words.pop("", None)
    for p in prose:
        for s in sentences(p):
            length = len(s.split())
            if length >= 3:
                build[f"\0n{_bucket(length, (6, 9, 13, 18, 25, 35, 50))}"] += 1
                build[f"\0c{min(s.count(',') + s.count(';'), 6)}"] += 1
    return sum(len(ws) for *_, ws in kept), words, build


class ReadingModel:
    """Acquisition grades of words and builds, and the calibration of their quantiles to bands."""

    def __init__(self, strength: float = 1.0):
        self.strength = strength

    def _grade(self, counts: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Expected band (0 to 2) of texts that hold a word, bands counting alike, for rows of counts by band."""
        n = counts.sum(1, keepdims=True)
        rate = (counts + self.strength * n / max(total.sum(), 1) / 3 + 1e-9) / (total + self.strength)
        mean = (rate / rate.sum(1, keepdims=True)) @ [0.0, 1.0, 2.0]
        return (mean * n[:, 0] + self.strength) / (n[:, 0] + self.strength)

    @staticmethod
    def _quantiles(grade: np.ndarray, count: np.ndarray) -> list[float]:
        if not len(grade):
            return [1.0] * (len(QUANTILES) + 1)
        order = np.argsort(grade, kind="stable")
        share = np.cumsum(count[order]) / count.sum()
        at = np.minimum(np.searchsorted(share, QUANTILES), len(grade) - 1)
        return [*grade[order][at].tolist(), float(grade @ count / count.sum())]

    def _features(self, words: Counter, build: Counter) -> np.ndarray:
        out = []
        for terms in (words, build):
            known = [(g, c) for t, c in terms.items() if (g := self.grades.get(t)) is not None]
            out += self._quantiles(*np.array(known, dtype=float).reshape(-1, 2).T)
        return np.array(out)

    def fit(self, docs: list[tuple[Counter, Counter, int]]) -> ReadingModel:
        """Fit on judged documents; those that contradict the others' model strongly are set aside, twice."""
        no: dict[str, int] = {}
        ids = [[np.array([no.setdefault(t, len(no)) for t in terms], dtype=int) for terms in d[:2]] for d in docs]
        times = [[np.fromiter(terms.values(), float, len(terms)) for terms in d[:2]] for d in docs]
        y = np.array([b for *_, b in docs])
        weight = np.ones(len(docs))
        for round_ in range(3):
            seen = np.zeros((len(no), 3))
            for parts, band, w in zip(ids, y, weight):
                for i in parts:
                    seen[i, band] += w
            total = np.bincount(y, weights=weight, minlength=3)
            x = []
            for parts, counts, band, w in zip(ids, times, y, weight):
                # a document's own say is taken out of the grades it is described by
                less = np.eye(3)[band] * w
                row = []
                for i, c in zip(parts, counts):
                    rest = seen[i] - less
                    known = rest.sum(1) >= 0.5
                    row += self._quantiles(self._grade(rest[known], total - less), c[known])
                x.append(row)
            x = np.array(x)
            self._calibrate(x, y, weight)
            p = self._probabilities(x)[np.arange(len(y)), y]
            if round_ < 2:
                weight = np.where(p < 0.15, 0.0, 1.0)
        kept = seen.sum(1) > 0
        grade = self._grade(seen, total)
        self.grades = {t: float(grade[i]) for t, i in no.items() if kept[i]}
        return self

    def _calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        z = np.hstack([(x - self.mean) / self.std, np.ones((len(x), 1))])
        want = np.eye(3)[y]
        share = (want * weight[:, None]).sum(0)
        balance = weight * (weight.sum() / 3 / np.maximum(share, 1))[y]
        self.w = np.zeros((z.shape[1], 3))
        velocity = np.zeros_like(self.w)
        for _ in range(800):
            e = z @ self.w
            p = np.exp(e - e.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            step = z.T @ ((p - want) * balance[:, None]) / max(balance.sum(), 1e-9) + 0.003 * self.w
            velocity = 0.9 * velocity - 0.3 * step
            self.w += velocity

    def _probabilities(self, x: np.ndarray) -> np.ndarray:
        e = np.hstack([(x - self.mean) / self.std, np.ones((len(x), 1))]) @ self.w
        p = np.exp(e - e.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def level(self, words: Counter, build: Counter) -> tuple[str, float]:
        """Band, and the expected band as a number from 0 to 2."""
        p = self._probabilities(self._features(words, build)[None, :])[0]
        return BANDS[int(p.argmax())], float(p @ [0, 1, 2])


def judged(labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, band`` of up to ``sample`` judged documents, chosen by a hash: the commonest band of each.

    Unknown and NULL bands and NULL documents are left out, and so are documents judged in equal parts.
    """
    n = labels.where(F.col("band").isin(BANDS) & F.col("doc_id").isNotNull()).groupBy("doc_id", "band").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("doc_id").agg(F.max(F.struct("n", "band")).alias("m"), F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    clear = best.where((F.size("ns") == 1) | (F.get("ns", F.lit(0)) > F.get("ns", F.lit(1))))
    return clear.select("doc_id", F.col("m.band").alias("band")).orderBy(F.xxhash64("doc_id")).limit(sample)


def fit_reading_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> ReadingModel | None:
    """The model of the judged documents that hold prose, None without any; the driver sees the words of at most ``sample`` documents."""
    chosen = F.broadcast(judged(labels, sample))  # at most ``sample`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(describe(t), band) for t, band in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            rows = [(list(w.items()), list(s.items()), band) for (n, w, s), band in rows if n >= LEAST_WORDS // 2]
            kind = pa.map_(pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.string())], names=["words", "build", "band"])

    got = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "band").mapInArrow(run, "words map<string,int>, build map<string,int>, band string").collect()
    rows = sorted(((sorted(r["words"].items()), sorted(r["build"].items()), BANDS.index(r["band"])) for r in got))
    return ReadingModel().fit([(Counter(dict(w)), Counter(dict(b)), band) for w, b, band in rows]) if rows else None


def reading_levels(docs: DataFrame, labels: DataFrame, least_words: int = LEAST_WORDS, sample: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, band, level, n_words`` of each document with ``least_words`` or more words of English prose.

    NULL, empty and blank texts, and texts without enough prose, have no row; whole texts are read.
    Without any judged document there is nothing to go by, and the result is empty. Repeated rows
    come out as often as they go in.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, band string, level double, n_words int"
    fitted = fit_reading_model(docs, labels, sample)
    if fitted is None:
        return spark.createDataFrame([], ddl)
    model = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, bands, levels, counts = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                n, words, build = describe(text)
                if n >= least_words:
                    band, level = model.value.level(words, build)
                    ids.append(i)
                    bands.append(band)
                    levels.append(level)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(bands, pa.string()), pa.array(levels, pa.float64()), pa.array(counts, pa.int32())], names=["doc_id", "band", "level", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, ddl)
