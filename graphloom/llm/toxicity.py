"""Toxicity: a noisy-channel decoder restores disguised words, then a linear model scores them."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import small_batches, staged

#: Labelled rows that the classifier is fitted on at most, in order of a hash of doc_id. Everything else counts all rows.
FIT_ROWS = 20_000
#: Different words or features that a task holds before it counts them up or passes them on.
HELD = 200_000
#: What a character may stand for besides itself, with the channel's log probabilities of a disguise, a repeat, a mark inside a
#: word and a space inside a word.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "*": "aeiou"}
DISGUISE, REPEAT, MARK, SPACE, FLOOR = -2.0, -1.0, -2.0, -1.0, -9.0
#: A character's class under all disguises: what a lattice can lead to has the classes of what it started from, repeats taken out.
CLASSES = {**{c: x[0] for c, x in LEET.items() if c != "*"}, "l": "i"}
_CLASSES = str.maketrans({**CLASSES, **dict.fromkeys(".,;:?\"'()[]{}#%&-_=~^<>/\\`", None)})
_RUN = re.compile(r"[^\W_]+")
_AGAIN = re.compile(r"(.)\1+", re.S)
_AGAIN_IN_LINE = re.compile(r"([^\n])\1+")
_ACCENTS = re.compile("[\u0300-\u036f]+")
_PART = re.compile(r"[\W_]+")
_MARKS = ".,;:?\"'()[]{}#%&-_=~^<>/\\`"


def fold(text: str) -> str:
    """Lower case, letters without their accents."""
    text = text.lower()
    return text if text.isascii() else _ACCENTS.sub("", unicodedata.normalize("NFKD", text))


def skeleton(text: str) -> str:
    """Classes of a folded text's characters, marks left out, repeats taken together."""
    return _AGAIN.sub(r"\1", text.translate(_CLASSES))


def symbol(c: str) -> str:
    """The language model's alphabet: a to z, one symbol for other letters, one for the rest."""
    return c if "a" <= c <= "z" else "?" if c.isalpha() else "#"


#: Symbols by number: the two ends of a word, a to z, other letters, digits.
_SYMBOLS = "^abcdefghijklmnopqrstuvwxyz?#$"
_CODES = np.full(0x110000, -1, dtype=np.int8)
#: Characters that are counted together.
STEP_CHARS = 1 << 20


def _codes(text: str) -> np.ndarray:
    """Symbols of a folded text's characters, 0 for what parts words."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _CODES[points]
    if (out < 0).any():
        for p in np.unique(points[out < 0]).tolist():
            c = chr(p)
            _CODES[p] = 0 if not c.isalnum() else _SYMBOLS.index(symbol(c))
        out = _CODES[points]
    return out


def trigrams(text: str) -> np.ndarray:
    """Counts of the trigrams of symbols, by number, over the words and numbers of a folded text; what mixes letters and digits may
    be a disguise and teaches nothing."""
    code = np.concatenate([[0], _codes(text), [0]]).astype(np.int64)
    begin = np.flatnonzero((code[1:] > 0) & (code[:-1] == 0)) + 1
    if not len(begin):
        return np.zeros(27_000, dtype=np.int64)
    digits = np.add.reduceat(code == 28, begin)
    length = np.flatnonzero((code[1:] == 0) & (code[:-1] > 0)) + 1 - begin
    mixed = np.flatnonzero((digits > 0) & (digits < length))
    keep = code > 0
    for i, n in zip(begin[mixed].tolist(), length[mixed].tolist(), strict=True):
        keep[i : i + n] = False
    at = np.flatnonzero(keep)
    before = code[at - 1]
    first = np.where(before > 0, code[at - 2], 0)
    out = np.bincount(first * 900 + before * 30 + code[at], minlength=27_000)
    end = at[~keep[at + 1]]
    return out + np.bincount(code[end - 1] * 900 + code[end] * 30 + 29, minlength=27_000)


def _count(batches):
    """Trigrams of a partition."""
    seen = np.zeros(27_000, dtype=np.int64)
    for batch in batches:
        held: list[str] = []
        size = 0
        for text in [*batch.column(0).to_pylist(), None]:
            rest = text or ""
            while len(rest) > STEP_CHARS:
                cut = max(rest.rfind(" ", 0, STEP_CHARS), rest.rfind("\n", 0, STEP_CHARS))
                cut = cut if cut > 0 else STEP_CHARS
                seen += trigrams(fold(rest[:cut]))
                rest = rest[cut:]
            held.append(rest)
            size += len(rest)
            if size >= STEP_CHARS:
                seen += trigrams(fold("\n".join(held)))
                held, size = [], 0
        seen += trigrams(fold("\n".join(held)))
    at = np.flatnonzero(seen)
    grams = [_SYMBOLS[g // 900] + _SYMBOLS[g // 30 % 30] + _SYMBOLS[g % 30] for g in at.tolist()]
    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(seen[at])], names=["gram", "n"])


def language_model(docs: DataFrame) -> dict[str, float]:
    """Log probabilities of a symbol after two others, counted over all words of all documents. There are 28 symbols and two ends
    of words, so no corpus gives more than 30**3 of them."""
    rows = docs.select("text").mapInArrow(_count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    total: Counter = Counter()
    for r in rows:
        total[r.gram[:2]] += r.n
    return {r.gram: float(np.log(r.n / (total[r.gram[:2]] + 1))) for r in rows}


def restore(span: str, lm: dict[str, float]) -> str:
    """Viterbi over the lattice of a folded span's characters. Each is itself or what it may stand for; a repeat may be dropped; a
    mark is dropped, at no cost at the span's ends, or parts two words if it is no sign for a letter; spaces are marks, too."""
    core = span.strip(_MARKS)
    if _plain(core):
        return core  # the lattice has one path: marks at the ends are dropped at no cost, letters are themselves
    beam = {("^", "^"): (0.0, "")}
    ends = (len(span) - len(span.lstrip(_MARKS + "!")), len(span.rstrip(_MARKS + "!")))
    before = ""
    for at, c in enumerate(span):
        after: dict = {}

        def take(state, score, text):
            if state not in after or score > after[state][0]:
                after[state] = (score, text)  # noqa: B023

        alnum = c.isalnum()
        options = [(c, symbol(c), 0.0)] if alnum else []
        options += [(x, x, DISGUISE) for x in LEET.get(c, "")]
        for (a, b), (score, text) in beam.items():
            for letter, x, cost in options:
                take((b, x), score + cost + lm.get(a + b + x, FLOOR), text + letter)
            if c == before:
                take((a, b), score + REPEAT, text)
            if not alnum:
                outside = at < ends[0] or at >= ends[1]
                take((a, b), score + (0.0 if outside else SPACE if c == " " else MARK if c not in LEET or c == "*" else 2 * MARK), text)
                if not outside and b != "^" and c not in LEET:
                    take(("^", "^"), score + lm.get(a + b + "$", FLOOR), text + " ")
        beam, before = after, c
    return max((s + (0.0 if b == "^" else lm.get(a + b + "$", FLOOR)), t) for (a, b), (s, t) in beam.items())[1]


def _plain(word: str) -> bool:
    return word.isalpha() and not _AGAIN.search(word)


def runs(words: list[str]) -> list[str]:
    """Runs of three and more single characters among a text's words."""
    out, run = [], []
    for w in [*words, "  "]:
        if len(w) == 1:
            run.append(w)
        else:
            if len(run) > 2:
                out.append(" ".join(run))
            run = []
    return out


def features(text: str, lm: dict[str, float], memo: dict[str, str], only: dict | None = None) -> set[str]:
    """Restored words of a text, and their first 4, 5 and 6 letters where they stand once, twice and three times or more; of these,
    those in `only`. Decoded are words with marks, digits or repeats in them, runs of single characters, and neighbours that are
    pieces of a word in `only`. What can't lead to one in `only`, by its skeleton, isn't looked at."""
    text = fold(text)
    words = text.split()
    often = Counter(words)
    spans: Counter = Counter()
    if only is None:
        near = often
    else:
        kinds = only["kinds"]
        kinds.take(often, only)
        classes, begins = kinds.classes, only["begins"]
        near = {w: often[w] for w in often.keys() & kinds.near}
        if not kinds.begin.isdisjoint(often):
            for at in [i for i, w in enumerate(words) if w in kinds.begin]:
                glued = classes[words[at]]
                for size in (2, 3):
                    if glued not in begins or at + size > len(words):
                        break
                    glued = _glue(glued, classes[words[at + size - 1]])
                    if glued in only["whole"]:
                        spans[" ".join(words[at : at + size])] += 1
    if b"\1\1\1" in bytes(map((1).__eq__, map(len, words))):
        for run in runs(words):
            if only is None or any(k in skeleton(run.replace(" ", "")) for k in only["whole"]):
                spans[run] += 1
    out: Counter = Counter()
    for w, n in near.items():
        if _plain(w):
            out[w] += n
        elif any(map(str.isalpha, w)):
            spans[w] += n
    for w, n in spans.items():
        got = memo.get(w)
        if got is None:
            got = restore(w, lm)
            if len(memo) < HELD:
                memo[w] = got
        for x in got.split():
            out[x] += n
    heads: Counter = Counter()
    for w, times in out.items():
        if only is None or w[:4] in only["heads"]:
            for n in (4, 5, 6):
                if len(w) > n:
                    heads[w[:n]] += times
    found = out.keys() | {f"{h}~{i}" for h, times in heads.items() for i in range(1, min(3, times) + 1)}
    return found if only is None else found & only["weights"].keys()


def _glue(a: str, b: str) -> str:
    """The skeleton of two pieces together."""
    return a + b[1:] if a[-1:] == b[:1] else a + b


def _parted(word: str, only: dict) -> bool:
    """Whether a word has a sign for any vowel after what may begin a feature, or marks inside it that part it into pieces of which
    one may lead to a feature."""
    word = word.strip(_MARKS)
    if "*" in word:
        begin = skeleton(word).partition("*")[0]
        return not word.replace("*", "").isalpha() or begin in only["opens"] or _leads(begin, only)
    return not word.isalnum() and any(_leads(skeleton(x), only) for x in _PART.split(word))


def _leads(k: str, only: dict) -> bool:
    """Whether what has this skeleton may be a word in `only` or have a head in it."""
    return k in only["whole"] or k[:3] in only["starts"] and any(k.startswith(h) for h in only["starts"][k[:3]])


class Kinds:
    """What a task has learnt of words: their skeletons, which of them may lead to a feature and which begin one.
    It is forgotten where it would hold more than HELD words or some 4 * STEP_CHARS characters of them, so no result depends on it."""

    def __init__(self):
        self.forget()

    def forget(self):
        self.classes: dict[str, str] = {}
        self.near: set[str] = set()
        self.begin: set[str] = set()
        self.chars = 0

    def take(self, words: Counter, only: dict):
        new = [w for w in words if w not in self.classes]
        if not new:
            return
        if len(self.classes) > HELD or self.chars > 4 * STEP_CHARS:
            self.forget()
            new = list(words)
        lines = "\n".join(new)
        self.chars += len(lines)
        whole, starts, begins = only["whole"], only["starts"], only["begins"]
        for w, k in zip(new, _AGAIN_IN_LINE.sub(r"\1", lines.translate(_CLASSES)).split("\n"), strict=True):
            self.classes[w] = k
            if k in whole or k[:3] in starts and _leads(k, only) or not w.isalpha() and _parted(w, only):
                self.near.add(w)
            if k in begins:
                self.begin.add(w)


def wanted(weights) -> dict:
    """What `features` looks for: the weights, first letters of heads, skeletons of words and of heads, and beginnings of words."""
    heads = {f.partition("~")[0] for f in weights if "~" in f}
    whole = {skeleton(f) for f in weights if "~" not in f}
    opens = {k[:n] for k in whole | {skeleton(h) for h in heads} for n in range(len(k) + 1)}
    starts: dict[str, list[str]] = {}
    for k in sorted({skeleton(h) for h in heads}):
        starts.setdefault(k[:3], []).append(k)
    return {"kinds": Kinds(), "weights": weights, "heads": {h[:4] for h in heads}, "whole": whole, "starts": starts, "opens": opens, "begins": {k[:n] for k in whole for n in range(2, len(k))}}


def _count_features(lm: dict[str, float]):
    """For mapInArrow over (text, toxic): in how many rows of each label a feature is; the empty feature is in all."""

    def run(batches):
        memo: dict[str, str] = {}
        seen = [Counter(), Counter()]

        def counted():
            keys = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[f] for f in keys], pa.int64()) for c in seen)], names=["feature", "clean", "toxic"])

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(features(text or "", lm, memo))
                seen[y][""] += 1
                if len(seen[0]) + len(seen[1]) >= HELD:
                    yield counted()
                    seen[0].clear(), seen[1].clear()
        yield counted()

    return run


def _plain_counts(batches):
    """For mapInArrow over (text): in how many rows a word without any disguise, or a head of such words, is; the empty word is in all."""
    for batch in batches:
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            words = Counter(w for w in fold(text or "").split() if w.isalpha())
            heads: Counter = Counter()
            for w, times in words.items():
                for n in (4, 5, 6):
                    if len(w) > n and not _AGAIN.search(w):
                        heads[w[:n]] += times
            seen.update(w for w in words if not _AGAIN.search(w))
            seen.update(f"{h}~{i}" for h, times in heads.items() for i in range(1, min(3, times) + 1))
            seen[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])


def candidates(known: DataFrame, lm: dict[str, float]) -> tuple[list[str], float]:
    """Features that may tell, and the number that all features of toxic rows are held against. Toxic rows are decoded; clean ones
    are counted without, which can only make a feature seem more telling than it is."""
    toxic = known.where("toxic = 1").mapInArrow(_count_features(lm), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("toxic").alias("toxic")).where("toxic >= 3 OR feature = ''")
    clean = known.where("toxic = 0").select("text").mapInArrow(_plain_counts, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("clean"))
    seen = staged(toxic.join(clean, "feature", "left").select("feature", F.coalesce("clean", F.lit(0)).alias("clean"), "toxic"), "candidates")
    return telling(seen), float(seen.count())


def telling(counts: DataFrame, among: float | None = None) -> list[str]:
    """The features, out of (feature, clean, toxic), that mark the toxic label by more than chance. Their number is bounded by the
    words of FIT_ROWS rows."""
    total = counts.where("feature = ''").first()
    if total is None or not total.clean or not total.toxic:
        return []
    n0, n1 = total.clean, total.toxic
    odds = F.log((F.col("toxic") + 0.2) / (n1 + 0.4)) - F.log((F.col("clean") + 0.2) / (n0 + 0.4))
    rate, both = n1 / (n0 + n1), F.col("toxic") + F.col("clean")

    def term(k, q):
        return F.when(k > 0, k * F.log(k / (both * q))).otherwise(0.0)

    # log likelihood ratio of the feature's own rate of toxic documents against the rate of all; chance stays under the bar
    gain = term(F.col("toxic"), rate) + term(F.col("clean"), 1 - rate)
    often = counts.where("feature <> '' AND toxic >= 3").withColumn("odds", odds).withColumn("gain", gain)
    bar = float(np.log(among or max(1, often.count())) + 1)
    return sorted(r.feature for r in often.where((F.col("odds") > 1.5) & (F.col("gain") > bar)).select("feature").collect())


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression of y on x, rows counting n times; Newton steps, halved where they overshoot."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(w):
        z = x @ w
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + (penalty * w * w).sum() / 2)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (n * (y - p)) - penalty * w)
        while loss(w + step) > loss(w) and abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if abs(step).max() < 1e-9:
            break
    return w


def _summed(lm: dict[str, float], weights: dict[str, float], bias: float):
    """For mapInArrow over (text, any): the weights of the text's features and the bias summed up, beside the second column."""

    def run(batches):
        memo: dict[str, str] = {}
        only = wanted(weights)
        for batch in batches:
            x = [evidence(t, lm, memo, only, bias) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.float64())], names=["y", "x"])

    return run


def evidence(text: str | None, lm: dict[str, float], memo: dict[str, str], only: dict, bias: float) -> float:
    return bias + sum(only["weights"][f] for f in sorted(features(text or "", lm, memo, only)))


def _held(lm: dict[str, float], names: list[str]):
    """For mapInArrow over (text, toxic): the numbers of the text's features, beside the label."""

    def run(batches):
        memo: dict[str, str] = {}
        number = {f: i for i, f in enumerate(names)}
        only = wanted(number)
        for batch in batches:
            found = [sorted(number[f] for f in features(t or "", lm, memo, only)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["y", "x"])

    return run


def fit(known: DataFrame, lm: dict[str, float]) -> tuple[dict[str, float], float]:
    """Weights of features and bias from known: (text, toxic). Features are counted and chosen where the rows are; the driver gets
    the rows' numbers of features, of which there are no more than of rows."""
    some, among = candidates(known, lm)
    total = known.groupBy().agg(F.lit("").alias("feature"), F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic"))
    names: list[str] = []
    if some:
        # each row's candidates are found once, then counted and, of those that tell, weighed
        found = staged(known.mapInArrow(_held(lm, some), "y int, x array<int>"), "found")
        each = found.select("y", F.explode("x").alias("f")).groupBy(F.get(F.array(*map(F.lit, some)), F.col("f")).alias("feature"))
        counts = staged(total.unionByName(each.agg(F.sum(1 - F.col("y")).alias("clean"), F.sum("y").alias("toxic"))), "features")
        names = telling(counts, among)
    if not names:
        # without evidence of its own no text is toxic, whatever the labels' rate
        n = total.first()
        return {}, -2.0 if n is None or n.toxic is None else float(min(-2.0, np.log((n.toxic + 0.2) / (n.clean + 0.2))))
    place = {some.index(f): i for i, f in enumerate(names)}
    rows = found.select(F.filter("x", lambda f: f.isin(list(place))).alias("x"), "y").groupBy("x", "y").agg(F.count("*").alias("n")).orderBy("x", "y").collect()
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [place[f] for f in r.x]] = 1
    w = logistic(x, np.array([r.y for r in rows], dtype=float), np.array([r.n for r in rows], dtype=float))
    return dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1])


def _model(docs: DataFrame, labels: DataFrame, held_out: int):
    small_batches(docs.sparkSession)
    lm = language_model(docs)
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    return lm, *fit(rows, lm)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels are learnt only from documents whose crc32(doc_id as text) modulo 4 isn't `held_out`, FIT_ROWS of them at most. The
    decoder's language model counts all documents; the score sees the text alone, all of it. Null and empty texts are scored like
    any (without features); null labels teach nothing, of several labels the highest does; without labels of both kinds every
    score is the same and below 0.3; ties in the order of labels go by doc_id; repeated rows each have their row; other columns of
    docs or labels, whatever their names, play no part; no rows give no rows.
    """
    lm, weights, bias = _model(docs, labels, held_out)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == held_out
    scored = docs.select("text", "doc_id").mapInArrow(_summed(lm, weights, bias), "y long, x double")
    scored = scored.select(F.col("y").alias("doc_id"), (1 / (1 + F.exp(-F.col("x")))).alias("score"))
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out: int = 2) -> DataFrame:
    """The rows of docs whose own text scores under the threshold, with all their columns. Rows are judged where they are."""
    lm, weights, bias = _model(docs, labels, held_out)
    bar = np.log(threshold / (1 - threshold))

    def keep(batches):
        memo: dict[str, str] = {}
        only = wanted(weights)
        for batch in batches:
            fine = [evidence(t, lm, memo, only, bias) < bar for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
