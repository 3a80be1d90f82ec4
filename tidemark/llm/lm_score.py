"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation (operator 6).

Words belong to classes: the end of a text, each of the most frequent words, and one class for each frequent word
ending. P(word | two classes before) = P(class | two classes before) * P(word | class). The first factor is a
log-bilinear model, trained by noise-contrastive estimation on every class trigram of all training texts: a start
from a sample of them, then one update of a copy in each task for each batch of its trigrams, and the mean of the
copies by their trigrams. It is normalised exactly by one matrix product over all contexts. The second factor comes
from the counts of all training texts. Words and endings that name classes are the most frequent of all training
texts, by heavy hitters of each task; the number of classes grows with the sixth root of the training tokens, so that
the table of all contexts grows with the cube root and the product that normalises it, which each task makes once, with the
square root: at 100 TB there are some 3,000 classes, the tables have 37 MB each and the product takes seconds.

Counts of words: those on a bounded list of frequent words are summed in each task and then by place, all other
words meet by hash in buckets, whose number grows with the input. A task packs its documents in flushes of bounded
size; a bucket returns sums to the flush, by the document's place in it. Frequent words are told apart exactly, others
by their class and a hash of at least 48 bits: with a billion of them some dozens may share the counts of another.

Defined cases: null text counts as empty and has the end token alone; very long texts are scored whole, in the task
that reads them; among equally frequent words and endings the smaller in bytes comes first; repeated rows get the same
values; a null id is hashed as the empty text; without training texts N and V are 0 and all tokens are unknown; an
empty table gives an empty result; extra columns are ignored. Counts and base scores do not depend on partitions, but for
the last digits of their sums. The trained model does: each task trains a copy on the texts that it reads, in its own order,
and the start's sample is drawn by partition. On other files or splits, scores differ by some hundredths of a decimal digit
a token (0.012 on 1,000 texts read by one task or by seven; a test holds it below 0.05, and that of the means below 0.03).
"""

from __future__ import annotations

import ctypes
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod, materialise, plan_bytes, quoted, raw_texts, release, steps
from .blobs import pack, slices, unpack

CLASSES = 128  # at least; class 0 is the end, the last quarter are endings, the one after all is the begin of a text
CLASS_GROWTH = 19
HEAVY, COUNTED = 20_000, 300_000  # frequent words; words that a task counts at a time
WIDTH, NOISE, BATCH, STEPS = 24, 32, 4096, 300
RATE, PASS_RATE = 0.15, 0.05
CACHE_WORDS = 100_000
SMOOTH = 0.1
FLUSH, FLUSH_TOKENS, FLUSH_DOCS = 500_000, 1_000_000, 60_000  # words that meet by hash, tokens and documents of a flush
BUCKET_BYTES = 8 << 20  # of the table, for a bucket of words
ROWS = 64  # blobs that leave a task at a time
_HEAVY_BIT = 1 << 63


def classes_for(tokens: int) -> int:
    return max(CLASSES, round(CLASS_GROWTH * tokens ** (1 / 6)))


class Vocabulary(dict):
    """Code of a word: class in the low bits; above them the place among the heavy words, marked by the top bit,
    or a hash of the word."""

    def __init__(self, words: list[str], endings: list[bytes], classes: int = CLASSES) -> None:
        self.heavy = {w: i for i, w in enumerate(words)}
        self.endings = {e: i for i, e in enumerate(endings)}
        self.classes, self.n_endings = classes, classes // 4
        self.n_words = self.named(classes)
        self.bits = (classes - 1).bit_length()
        self.mask = (1 << self.bits) - 1

    def __reduce__(self):
        return Vocabulary, (list(self.heavy), list(self.endings), self.classes)

    @staticmethod
    def named(classes: int) -> int:
        """Words with a class of their own."""
        return classes - classes // 4 - 1

    @staticmethod
    def ending(word: bytes) -> bytes:
        return word.rstrip(b".,;:!?*#$%&|")[-2:]

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        place = self.heavy.get(word)
        if place is not None and place < self.n_words:
            kind = 1 + place
        else:
            kind = self.classes - self.n_endings + self.endings.get(self.ending(word), self.n_endings - 1)
        self[word] = code = (_HEAVY_BIT | place << self.bits | kind) if place is not None else (xxhash.xxh64_intdigest(word) & (_HEAVY_BIT - 1) & ~self.mask) | kind
        return code

    def codes(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        return (codes & np.uint64(self.mask)).astype(np.int64)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Of codes of heavy words, their places."""
        return ((codes & np.uint64(_HEAVY_BIT - 1)) >> np.uint64(self.bits)).astype(np.int64)


def _vocabulary(rows: DataFrame) -> tuple[Vocabulary, int]:
    """The most frequent words and endings of all training texts, and the number of tokens; they name classes."""

    def counted(batches):
        seen: Counter = Counter()
        endings: Counter = Counter()
        tokens = 0

        def drop(words):
            for w, n in words:
                endings[Vocabulary.ending(w)] += n

        for batch in batches:
            for step in steps([batch], "text"):
                for text in raw_texts(step.column("text")):
                    words = text.lower().split()
                    tokens += len(words) + 1
                    seen.update(words)
                    if len(seen) > COUNTED:
                        top = seen.most_common()
                        drop(top[COUNTED // 2 :])
                        seen = Counter(dict(top[: COUNTED // 2]))
        drop(seen.items())
        top = seen.most_common(4 * HEAVY)
        out = [(0, w, n) for w, n in top] + [(1, e, n) for e, n in endings.items()] + [(2, b"", tokens)]
        kind, name, n = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(name, pa.binary()), pa.array(n, pa.int64())], ["k", "w", "n"])

    counts = materialise(rows.where("NOT held").select("text").mapInArrow(counted, "k int, w binary, n long").groupBy("k", "w").agg(F.sum("n").alias("n")), "lm-words")
    found = counts.where("k > 0").collect()  # endings have two bytes at most
    top = [(bytes(r.w), r.n) for r in counts.where("k = 0").orderBy(F.desc("n"), "w").limit(HEAVY).collect()]
    tokens = sum(r.n for r in found if r.k == 2)
    classes = classes_for(tokens)
    endings = Counter({bytes(r.w): r.n for r in found if r.k == 1})
    for w, n in top[: Vocabulary.named(classes)]:
        endings[Vocabulary.ending(w)] -= n
    names = [e for e, n in sorted(endings.items(), key=lambda x: (-x[1], x[0])) if n > 0]
    return Vocabulary([w for w, _ in top], names[: classes // 4 - 1], classes), tokens


class Texts:
    """The codes of some texts, one after the other, and their class trigrams; each text ends with class 0."""

    def __init__(self, words: Vocabulary, texts: list[bytes]) -> None:
        each = [words.codes(t) for t in texts]
        self.codes = np.concatenate([np.zeros(0, np.uint64), *each])
        self.n = np.array([len(c) for c in each], np.int64)
        self.doc = np.repeat(np.arange(len(each)), self.n)
        self.ends = np.cumsum(self.n + 1) - 1
        self.starts = self.ends - self.n
        self.target = np.zeros(len(self.codes) + len(each), np.int64)
        inner = np.ones(len(self.target), bool)
        inner[self.ends] = False
        self.target[inner] = words.kinds(self.codes)
        self.two = np.append(words.classes, self.target[:-1])[: len(self.target)]
        self.two[self.starts] = words.classes  # before a text is the class after all
        self.one = np.append(words.classes, self.two[:-1])[: len(self.target)]
        self.one[self.starts] = words.classes
        self.heavy = self.codes >= _HEAVY_BIT
        self.place = words.places(self.codes[self.heavy])

    def grams(self) -> np.ndarray:
        return np.stack([self.one, self.two, self.target])


def _sample(rows: DataFrame, words: Vocabulary, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct class trigrams of about STEPS * BATCH tokens of training texts, and how often they occur there."""
    wide = words.classes + 1

    def counted(batches):
        for batch in batches:
            for step in steps([batch], "text"):
                one, two, target = Texts(words, raw_texts(step.column("text"))).grams()
                k, n = np.unique((one * wide + two) * wide + target, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["k", "n"])

    some = rows.where("NOT held").select("text").sample(fraction=min(1.0, STEPS * BATCH / max(1, tokens)), seed=11)
    got = some.mapInArrow(counted, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = got.column("k").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(k)
    context, target = np.divmod(k[order], wide)
    return np.stack([*np.divmod(context, wide), target]), n[order]


class LogBilinear:
    """Score of class c after classes a, b: q_c . (A r_a + B r_b) + bias_c."""

    NAMES = ("r", "q", "a", "b", "bias")

    def __init__(self, rng: np.random.Generator, by_class: np.ndarray) -> None:
        classes = len(by_class)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.r, self.q = small(classes + 1, WIDTH), small(classes, WIDTH)
        self.a, self.b = np.eye(WIDTH, dtype=np.float32) * np.float32(0.5), np.eye(WIDTH, dtype=np.float32) * np.float32(0.8)
        noise = (by_class + 0.5) / (by_class + 0.5).sum()
        self.noise, self.drawn = np.log(NOISE * noise).astype(np.float32), np.cumsum(noise)
        self.bias = np.log(noise).astype(np.float32)
        self.square = {n: np.full_like(getattr(self, n), 1e-2) for n in self.NAMES}

    @classmethod
    def start(cls, by_class: np.ndarray, grams: np.ndarray, weights: np.ndarray | None = None, updates: int = STEPS, seed: int = 5) -> LogBilinear:
        """A model from trigrams, drawn by their weights."""
        rng = np.random.default_rng(seed)
        model = cls(rng, by_class)
        n = grams.shape[1]
        if n:
            cumulative = np.cumsum(np.ones(n) if weights is None else weights.astype(float))
            for step in range(updates):
                at = np.minimum(np.searchsorted(cumulative, rng.random(BATCH) * cumulative[-1], side="right"), n - 1)
                model.update(grams[:, at], rng, RATE * (1 - 0.9 * step / updates))
        return model

    def update(self, grams: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """A step of noise-contrastive estimation with Adagrad; the batch shares NOISE classes drawn by the class
        counts. Products with A and B are taken by class, not by trigram."""
        one, two, target = grams
        n = len(target)
        picks = np.minimum(np.searchsorted(self.drawn, rng.random(NOISE)), len(self.bias) - 1)
        offset = self.bias - self.noise
        hidden = (self.r @ self.a.T)[one] + (self.r @ self.b.T)[two]
        qt, qn = self.q[target], self.q[picks]
        up = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", hidden, qt) + offset[target], -30, 30))) / np.float32(n)
        down = np.float32(-1 / n) / (1 + np.exp(-np.clip(hidden @ qn.T + offset[picks], -30, 30)))
        grad_hidden = up[:, None] * qt + down @ qn
        grad_q, grad_bias = _summed(target, up[:, None] * hidden, len(self.q)), np.bincount(target, up, len(self.q)).astype(np.float32)
        np.add.at(grad_q, picks, down.T @ hidden)
        np.add.at(grad_bias, picks, down.sum(0))
        by_one, by_two = _summed(one, grad_hidden, len(self.r)), _summed(two, grad_hidden, len(self.r))
        for name, grad in zip(self.NAMES, (by_one @ self.a + by_two @ self.b, grad_q, by_one.T @ self.r, by_two.T @ self.r, grad_bias)):
            self.square[name] += grad**2 * n
            getattr(self, name)[...] += np.float32(rate * math.sqrt(n)) * grad / np.sqrt(self.square[name])

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def take(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            own = getattr(self, n)
            own[...] = flat[at : at + own.size].reshape(own.shape)
            at += own.size

    def parts(self, kind: type = float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural log of P(c | a, b) is left[a, c] + right[b, c] - total[a, b], normalised over all classes."""
        r, q, bias = self.r.astype(kind), self.q.astype(kind), self.bias.astype(kind)
        left, right = r @ self.a.T.astype(kind) @ q.T, r @ self.b.T.astype(kind) @ q.T + bias
        left -= left.max(1, keepdims=True)
        right -= right.max(1, keepdims=True)
        total = np.exp(left) @ np.exp(right).T
        np.maximum(total, np.finfo(kind).tiny, out=total)
        return left, right, np.log(total, out=total)

    def log10_table(self) -> np.ndarray:
        """Normalised log10 probabilities of every class in every context, flat."""
        left, right, total = self.parts()
        return ((left[:, None] + right[None] - total[:, :, None]) / math.log(10)).ravel()


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their place."""
    order = np.argsort(at, kind="stable")
    places = at[order]
    first = np.concatenate([[0], np.nonzero(np.diff(places))[0] + 1])
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[places[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _one_thread() -> None:
    """Lets this process multiply in one thread: for small products more threads only spin while they wait."""
    with open("/proc/self/maps") as maps:
        paths = {line.split()[-1] for line in maps if "openblas" in line}
    for path in paths:
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            limit = getattr(ctypes.CDLL(path), name, None)
            if limit:
                limit(1)


def _passed(rows: DataFrame, words: Vocabulary, model: LogBilinear | None) -> tuple[np.ndarray, np.ndarray]:
    """Trains the model, where there is one, on every trigram of all training texts: a copy in each task, then their mean. Returns
    the counts of classes and of heavy words in all of them. Sums meet by place, a row each."""
    counted = words.classes + HEAVY

    def trained(batches):
        counts, rng = np.zeros(counted), np.random.default_rng(TaskContext.get().partitionId())
        held: list = []
        size = n = 0
        _one_thread()

        def learn():
            grams = np.concatenate(held, axis=1)[:, rng.permutation(size)]
            for at in range(0, size, BATCH):
                model.update(grams[:, at : at + BATCH], rng, PASS_RATE)
            held.clear()

        for batch in batches:
            for step in steps([batch], "text"):
                texts = Texts(words, raw_texts(step.column("text")))
                counts[: words.classes] += np.bincount(texts.target, minlength=words.classes)
                counts[words.classes :] += np.bincount(texts.place, minlength=HEAVY)
                if model is None:
                    n += len(texts.n)
                    continue
                held.append(texts.grams().astype(np.int32))
                size += held[-1].shape[1]
                if size >= 64 * BATCH:
                    learn()
                    n, size = n + size, 0
        if size:
            learn()
            n += size
        if n:
            sums = np.concatenate([counts, model.flat().astype(float) * n, [n]]) if model else counts
            own = np.nonzero(sums)[0]
            for at in range(0, len(own), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(own[at : at + 10_000]), pa.array(sums[own[at : at + 10_000]])], ["k", "v"])

    found = rows.where("NOT held").select("text").mapInArrow(trained, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(counted + (len(model.flat()) + 1 if model else 0))
    total[found.column("k").to_numpy()] = found.column("v").to_numpy()
    if model and total[-1]:
        model.take(total[counted:-1] / total[-1])
    counts = np.rint(total[:counted]).astype(np.int64)
    return counts[: words.classes], counts[words.classes :]


class Fitted:
    """What scoring needs: the words, the model, and the training counts of classes and of heavy words."""

    def __init__(self, words: Vocabulary, model: LogBilinear | None, by_class: np.ndarray, heavy: np.ndarray) -> None:
        self.words, self.model, self.by_class, self.heavy = words, model, by_class, heavy


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(quoted(id_col).cast("long").alias("i"), quoted(text_col).cast("string").alias("text"))
    return rows.withColumn("held", crc_mod(F.col("i"), 10) == 0)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts_only: bool = False) -> Fitted:
    """With `counts_only` no model is trained: scores are null then, and base scores and counts the same."""
    rows = _rows(df, id_col, text_col)
    words, tokens = _vocabulary(rows)
    if counts_only:
        return Fitted(words, None, *_passed(rows, words, None))
    grams, weights = _sample(rows, words, tokens)
    model = LogBilinear.start(np.bincount(grams[2], weights, words.classes), grams, weights)
    return Fitted(words, model, *_passed(rows, words, model))


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fitted: Fitted | None = None) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    fitted = fitted or fit(df, id_col, text_col)
    words, model, by_class, heavy = fitted.words, fitted.model, fitted.by_class, fitted.heavy
    n_train, n_texts = int(by_class.sum()), int(by_class[0])
    heavy_log, heavy_known = np.log10(heavy + SMOOTH), heavy > 0
    end_log = math.log10(n_texts + SMOOTH)
    size = plan_bytes(df)
    buckets = max(64, -(-size // BUCKET_BYTES))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (2 * BUCKET_BYTES)))
    n_words, n_endings = words.n_words, words.n_endings
    rare_from = words.classes - n_endings
    top = np.uint64(_HEAVY_BIT)

    def scanned(batches):
        _one_thread()
        left, right, total = model.parts(np.float32) if model else (None, None, None)
        place = TaskContext.get().partitionId()
        held: list[list[np.ndarray]] = []
        flushes = docs = rare = tokens = 0

        def flush():
            """One row with all that the flush knows of its documents, and one for each bucket of its rare words."""
            nonlocal flushes, docs, rare, tokens
            *facts, codes, doc = (np.concatenate(x) for x in zip(*held))
            f = -1 - (place << 32 | flushes)
            flushes += 1
            docs = rare = tokens = 0
            held.clear()
            out = [(f, f, pack(*facts), None)]
            for key, own in slices((((codes >> np.uint64(20)) & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)):
                step = np.diff(doc[own], prepend=0)
                out.append((key, f, None, pack(codes[own], (step & 255).astype("u1"), (step >> 8).astype("<u2"))))
            for at in range(0, len(out), ROWS):
                k, flush_of, b, d = zip(*out[at : at + ROWS])
                n = len(k)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(flush_of, pa.int64()), pa.array(b, pa.binary()), pa.array(d, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], ["k", "f", "b", "d", "c", "n"])

        for batch in batches:
            for step in steps([batch], "text"):
                if not step.num_rows:
                    continue
                ids = step.column("i")
                out = step.column("held").to_numpy(zero_copy_only=False)
                texts = Texts(words, raw_texts(step.column("text")))
                n = len(texts.n)
                lm = np.full(n, np.nan) if model is None else np.add.reduceat(left[texts.one, texts.target] + right[texts.two, texts.target] - total[texts.one, texts.two], texts.starts, dtype=float) / math.log(10)
                of = texts.doc[texts.heavy]
                log = heavy_log[texts.place]
                base = np.bincount(of, log, n) + end_log
                # Words with a class of their own have probability 1 in it; words of endings are weighted by their counts.
                lm += np.bincount(of, log * (texts.place >= n_words), n)
                known = np.bincount(of, heavy_known[texts.place], n).astype(np.int64) + (n_texts > 0)
                kinds = words.kinds(texts.codes)
                ending = kinds >= rare_from
                other = ~texts.heavy
                codes = np.where(out[texts.doc[other]], texts.codes[other], texts.codes[other] | top)  # the top bit: a training text's
                held.append([pc.fill_null(ids, 0).to_numpy(), np.asarray(ids.is_null()).astype("u1"), out.astype("u1"), texts.n + 1, known, base, lm,
                             np.bincount(texts.doc[ending], minlength=n).astype("<u4"), (kinds[ending] - rare_from).astype("<u4"), codes, texts.doc[other] + docs])
                docs, rare, tokens = docs + n, rare + len(codes), tokens + len(texts.codes)
                if rare >= FLUSH or docs >= FLUSH_DOCS or tokens >= FLUSH_TOKENS:
                    yield from flush()
        if held:
            yield from flush()
        release()

    kind = "k long, f long, b binary, d binary, c long, n long"

    def met(table: pa.Table) -> pa.Table:
        """Of one bucket: sums by the documents of each flush, and its words in training texts by ending; others as they are."""
        if table.column("k")[0].as_py() < 0:
            return table
        flushes = table.column("f").to_pylist()
        blobs = [unpack(b, "<u8", "u1", "<u2") for b in table.column("d").to_pylist()]
        codes = np.concatenate([b[0] for b in blobs])
        word, at = np.unique(codes & ~top, return_inverse=True)
        count = np.bincount(at, codes >= top, len(word))
        distinct = np.bincount(((word & np.uint64(words.mask)).astype(np.int64) - rare_from)[count > 0], minlength=n_endings)
        log, seen, first, out = np.log10(count + SMOOTH)[at], (count > 0)[at], 0, []
        for f, (own, low, high) in zip(flushes, blobs):
            doc, of = np.unique(np.cumsum(low.astype(np.int64) | high.astype(np.int64) << 8), return_inverse=True)
            here = slice(first, first + len(own))
            out.append((f, pack(doc.astype("<u4"), np.bincount(of, log[here]), np.bincount(of, seen[here]).astype("<u4"))))
            first += len(own)
        c = np.nonzero(distinct)[0]
        n = len(c)
        f = pa.array([x[0] for x in out] + [None] * n, pa.int64())
        return pa.table({"k": f, "f": f, "b": pa.nulls(len(f), pa.binary()), "d": pa.array([x[1] for x in out] + [None] * n, pa.binary()), "c": pa.array([None] * len(out) + c.tolist(), pa.int64()), "n": pa.array([None] * len(out) + distinct[c].tolist(), pa.int64())})

    kept = materialise(_rows(df, id_col, text_col).mapInArrow(scanned, kind).repartition(parts, "k").groupBy("k").applyInArrow(met, kind), "lm-sums")
    distinct = np.zeros(n_endings, np.int64)
    for c, n in kept.where("c IS NOT NULL").groupBy("c").agg(F.sum("n")).collect():  # a row for each ending at most
        distinct[c] = n
    n_types = int(distinct.sum() + heavy_known.sum() + (n_texts > 0))
    for place, word in enumerate(words.heavy):
        if place >= n_words and heavy_known[place]:
            distinct[words.endings.get(Vocabulary.ending(word), n_endings - 1)] += 1
    base_scale = math.log10(n_train + SMOOTH * (n_types + 1))
    class_scale = np.log10(by_class[rare_from:] + SMOOTH * (distinct + 1))

    def closed(table: pa.Table) -> pa.Table:
        """Of one flush, its documents with the sums that the buckets have returned."""
        blobs = table.column("b").to_pylist()
        ids, null, out, n, known, base, lm, endings, ending = unpack(next(b for b in blobs if b is not None), "<i8", "u1", "u1", "<i8", "<i8", "<f8", "<f8", "<u4", "<u4")
        total, more = np.zeros(len(n)), np.zeros(len(n), np.int64)
        for blob in table.column("d").to_pylist():
            if blob is not None:
                doc, log, seen = unpack(blob, "<u4", "<f8", "<u4")
                total[doc] += log
                more[doc] += seen
        inside = np.bincount(np.repeat(np.arange(len(n)), endings), class_scale[ending], len(n))
        return pa.table({
            "i": pa.array(ids, mask=null == 1), "held_out": pa.array(out == 1), "n_tokens": pa.array(n), "n_known": pa.array(known + more), "train_tokens": pa.array(np.full(len(n), n_train)),
            "base_score": pa.array(base + total - n * base_scale), "score": pa.array(lm + total - inside, from_pandas=True),
        })

    done = kept.where("k IS NOT NULL").select("k", "b", "d").repartition(parts, "k").groupBy("k").applyInArrow(closed, "i long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumnRenamed("i", id_col)


_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({x}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"
#: Counts and base scores; the checksum is taken bit by bit.
BASE_SQL = rf"""
WITH d AS (SELECT doc_id, {_CRC.format(x="CAST(doc_id AS VARCHAR)")} % 10 = 0 AS held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS ws FROM documents),
t AS (SELECT doc_id, held_out, unnest(ws) AS w FROM d),
c AS MATERIALIZED (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS total, count(*) AS types FROM c)
SELECT t.doc_id, t.held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.total) AS train_tokens,
       round(sum(log10((coalesce(c.c, 0) + 0.1::DOUBLE) / (n.total + 0.1::DOUBLE * (n.types + 1)))), 6) AS base_score
FROM t LEFT JOIN c USING (w), n GROUP BY t.doc_id, t.held_out
"""
