"""Subjects of documents: complement naive Bayes, expectation-maximisation over all documents, calibrated posteriors.

A document is parted into sentences, a sentence into hashed words. The model holds, per language and subject, the
log-odds of each word against the complement (all other sentences of the language, so that the words of a language speak
for no subject). It starts from labelled documents, whose sentences share the
document's labels, and is refined over every document, labelled or not: sentences are assigned softly, with the
document's own mix of subjects as prior and "no subject" as an alternative; a sentence without one counts by its document's mix, so
phrases common to all documents stay neutral; then the counts are taken again. The share of
a document's subject-bearing sentences that deal with a subject is its score; a logistic curve per subject turns scores
into independent posteriors, and a posterior of at least one half makes a row. The share that is asked for fixes where the
curve crosses one half; labelled documents that were held out of the fit fix how steep it is.

Size: words are hashed to 2**``bits`` buckets per language. The model holds the buckets that occur; its size is checked
before it is sent to the workers (``MODEL_BYTES``). Each round is one narrow pass over the word lists, written once, with a
partial sum per task; only bucket sums move.

Defined cases: null and empty texts, and texts without any subject-bearing sentence, give no row; a document in several
rows gives rows for each; labels of absent documents and null labels are ignored; no labels or no documents give no rows;
very long texts are read whole; ties at the threshold are included.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from ledgerquarry.functions.text import literal_map
from ledgerquarry.runtime import bounded_rows, cut

#: A sentence without a word that speaks for a subject stays without one: the log-odds a subject must exceed.
NO_SUBJECT = 5.0
#: Labelled words per subject at which the first round asks for half of that; it rises to the whole in three rounds.
HALF_KNOWN = 1000.0
#: A subject that no other sentence of the document deals with keeps this much of the prior.
PRIOR_FLOOR = 0.01
#: Weight of the corpus-wide word distribution in the estimates, in words.
PRIOR_WORDS = 300.0
CHUNK = 400_000
_SENTENCE = re.compile(r"(?<=[.!])[\s>]+|\n[\s>]*\n|\s(?=- \S)|(?<=\))\s+(?=[A-ZÄÖÜÉ])")
# Function words that tell the language where the table doesn't.
FUNCTION_WORDS = {
    "en": {"the", "and", "of", "to", "was", "for", "has", "this", "that", "with"},
    "fr": {"le", "la", "les", "et", "de", "du", "une", "est", "chez", "pour"},
    "de": {"der", "die", "das", "und", "ist", "wurde", "zu", "bei", "mit", "auf"},
}
#: Every language has a model of its own; more names than this are no languages, and are refused.
MOST_LANGUAGES = 1000
#: The most a model may take in each worker.
MODEL_BYTES = 512 * 1024 * 1024
#: One of so many labelled documents, by hash of its id, is held out of the fit to calibrate.
HELD_OUT = 10
_WORD = re.compile(r"[^\W\d_]{2,}")


def sentences(text: str) -> list[str]:
    """A full stop or exclamation mark, an empty line or a list mark ends a sentence; a question goes on into its answer."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


@lru_cache(maxsize=500_000)
def _bucket(word: str, bits: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) >> (32 - bits)


def language_of(seen: dict[str, int]) -> str:
    """The language whose function words are most frequent; en on a tie."""
    return max(FUNCTION_WORDS, key=lambda k: (seen.get(k, 0), k == "en"))


def _featurise(bits: int, languages: list[str]):
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, lengths, langs = [], [], []
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                w: list[int] = []
                n: list[int] = []
                seen: dict[str, int] = {}
                for s in sentences(text.as_py() or ""):
                    found = _WORD.findall(s.lower())
                    if found:
                        w += [_bucket(x, bits) for x in found]
                        n.append(len(found))
                        if not lang:
                            for k, known in FUNCTION_WORDS.items():
                                seen[k] = seen.get(k, 0) + sum(x in known for x in found)
                words.append(w)
                lengths.append(n)
                langs.append(number[lang or language_of(seen)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32())), pa.array(langs, pa.int32()), batch.column("labels"), batch.column("held")],
                ["doc_id", "words", "lengths", "lang", "labels", "held"],
            )

    return run


class Block:
    """Some whole documents of a batch: words of all sentences, words per sentence, document of each sentence."""

    def __init__(self, batch: pa.RecordBatch, start: int, stop: int, w_off: np.ndarray, s_off: np.ndarray, langs: np.ndarray):
        self.start, self.n_docs = start, stop - start
        self.lengths = np.asarray(batch.column("lengths").values)[s_off[start] : s_off[stop]].astype(np.int64)
        self.docs = np.repeat(np.arange(stop - start), np.diff(s_off[start : stop + 1]))
        self.lang = langs[start:stop]
        self.words = np.asarray(batch.column("words").values)[w_off[start] : w_off[stop]]
        self.word_lang = np.repeat(self.lang, np.diff(w_off[start : stop + 1]))
        self.at: np.ndarray | None = None


def blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    """The batch in blocks of bounded size, but for single documents that are longer."""
    w_off, s_off = (np.asarray(batch.column(c).offsets).astype(np.int64) for c in ("words", "lengths"))
    langs, start = np.asarray(batch.column("lang")).astype(np.int64), 0
    while start < batch.num_rows:
        stop = min(batch.num_rows, max(start + 1, int(np.searchsorted(w_off, w_off[start] + CHUNK, "right")) - 1))
        if w_off[stop] > w_off[start]:
            yield Block(batch, start, stop, w_off, s_off, langs)
        start = stop


class Weights:
    """Log-odds of the buckets that occur, with the row of each (language, bucket); row 0 is for what was never seen."""

    def __init__(self, at: np.ndarray, rows: np.ndarray, n_lang: int, bits: int):
        self.bits, self.rows = bits, np.concatenate([np.zeros((1, rows.shape[1]), dtype=np.float32), rows])
        self.place = np.zeros(n_lang << bits, dtype=np.int32)
        self.place[at] = np.arange(1, len(at) + 1, dtype=np.int32)
        self.buckets = np.concatenate([[-1], at]).astype(np.int32)
        if self.rows.nbytes + self.place.nbytes > MODEL_BYTES:
            raise ValueError(f"the model takes {self.rows.nbytes + self.place.nbytes} bytes, over MODEL_BYTES; use fewer bits")

    def places(self, b: Block) -> np.ndarray:
        """The rows of a block's words; looked up once for scores and counts."""
        if b.at is None:
            b.at = self.place[(b.word_lang << self.bits) + b.words]
        return b.at


def posteriors(weights: Weights, b: Block, labels: list[list[int]] | None, no_subject: float = NO_SUBJECT) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, subject) posteriors, what is missing to one being 'no subject', and each document's mix of subjects,
    which is the prior of its sentences."""
    k = weights.rows.shape[1]
    starts = np.concatenate([[0], np.cumsum(b.lengths)[:-1]])
    scores = np.add.reduceat(weights.rows[weights.places(b)], starts, axis=0).astype(np.float64)
    given = np.ones((b.n_docs, k))
    for d, ls in enumerate(labels or ()):
        if ls:
            given[d] = 0.1
            given[d, ls] = 1.0
    prior = given
    for _ in range(3):
        z = np.concatenate([scores + np.log(prior)[b.docs], np.full((len(b.docs), 1), no_subject)], axis=1)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        mix = np.stack([np.bincount(b.docs, weights=p[:, s], minlength=b.n_docs) for s in range(k)], axis=1)
        mix = given * (mix + 0.02)
        mix /= mix.sum(axis=1, keepdims=True)
        # The document's main subject is as likely as if nothing were known of the document.
        prior = np.maximum(mix / mix.max(axis=1, keepdims=True), PRIOR_FLOOR)
    return p[:, :k], mix


def _count(bits: int, k: int, n_lang: int, model, no_subject: float):
    """Sums by language and bucket: c0 all words, c1..ck words by subject."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums by bucket: of the buckets the model knows, which are all there are, or, before there is a model, by language.
        sums: dict[int, np.ndarray] = {} if model is None else {-1: np.zeros((k + 1, len(model.value.buckets)))}

        def add(key: int, width: int, at: np.ndarray, p: np.ndarray, sentence: np.ndarray) -> None:
            total = sums.setdefault(key, np.zeros((k + 1, width)))
            total[0] += np.bincount(at, minlength=width)
            for s in np.flatnonzero(p.any(axis=0)):
                total[s + 1] += np.bincount(at, weights=p[sentence, s], minlength=width)

        for batch in batches:
            labels = batch.column("labels").to_pylist()
            for b in blocks(batch):
                own = [ls or [] for ls in labels[b.start : b.start + b.n_docs]]
                sentence = np.repeat(np.arange(len(b.docs)), b.lengths)
                if model is None:
                    share = np.zeros((b.n_docs, k))
                    for d, ls in enumerate(own):
                        if ls:
                            share[d, ls] = 1.0 / len(ls)
                    for lang in np.unique(b.lang):
                        mine = b.word_lang == lang
                        add(int(lang), size, b.words[mine], share[b.docs], sentence[mine])
                else:
                    p, mix = posteriors(model.value, b, own, no_subject)
                    p = p + (1 - p.sum(axis=1, keepdims=True)) * mix[b.docs]
                    add(-1, len(model.value.buckets), model.value.places(b), p, sentence)
        for key, total in sums.items():
            used = np.flatnonzero(total[0])
            for i in range(0, len(used), 20_000):
                part = used[i : i + 20_000]
                bucket = part + (key << bits) if model is None else model.value.buckets[part]
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *[pa.array(total[s, part]) for s in range(k + 1)]], ["bucket", *[f"c{s}" for s in range(k + 1)]])

    return run


def log_odds(counts: np.ndarray) -> np.ndarray:
    """For one language, per bucket and subject, the log-odds of a word against the complement.

    Estimates lean on the language's word distribution with the weight of PRIOR_WORDS words, and half a count is
    discounted, so a word seen once says little.
    """
    total, by = counts[0], counts[1:]
    every, assigned = total / max(total.sum(), 1.0), counts[1:].sum(axis=0)
    out = np.zeros((total.size, by.shape[0]), dtype=np.float32)
    for s in range(by.shape[0]):
        inside, outside = np.maximum(by[s] - 0.5, 0.0), np.maximum(assigned - by[s] - 0.5, 0.0)
        a = (inside + PRIOR_WORDS * every) / (inside.sum() + PRIOR_WORDS)
        b = (outside + PRIOR_WORDS * every) / (outside.sum() + PRIOR_WORDS)
        out[:, s] = np.where(total > 0, np.clip(np.log(np.maximum(a, 1e-12) / np.maximum(b, 1e-12)), -2.5, 6.0), 0.0)
    return out


def _gather(features: DataFrame, bits: int, k: int, n_lang: int, model, no_subject: float = NO_SUBJECT) -> tuple[Weights, float]:
    """Weights from the counts of one pass over all documents, and the words per subject."""
    schema = "bucket int, " + ", ".join(f"c{s} double" for s in range(k + 1))
    summed = features.mapInArrow(_count(bits, k, n_lang, model, no_subject), schema).groupBy("bucket").agg(*[F.sum(f"c{s}").alias(f"c{s}") for s in range(k + 1)])
    table = summed.toArrow()  # at most the buckets that occur: languages x 2**bits
    at = np.asarray(table.column("bucket")).astype(np.int64)
    order = np.argsort(at)
    at, counts = at[order], np.stack([np.asarray(table.column(f"c{s}"))[order] for s in range(k + 1)])
    rows = np.zeros((len(at), k), dtype=np.float32)
    for lang in np.unique(at >> bits):
        mine = (at >> bits) == lang
        rows[mine] = log_odds(counts[:, mine])
    return Weights(at, rows, n_lang, bits), float(counts[1:].sum()) / k


def _shares(model, names: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        for batch in batches:
            ids = batch.column("doc_id")
            for b in blocks(batch):
                p, _ = posteriors(model.value, b, None)
                chosen = np.where(p.sum(axis=1) > 0.5, p.argmax(axis=1), k)
                n = np.bincount(b.docs * (k + 1) + chosen, minlength=b.n_docs * (k + 1)).reshape(b.n_docs, k + 1)[:, :k]
                d, s = np.nonzero(n)
                if len(d):
                    any_subject = n.sum(axis=1)
                    columns = [ids.take(pa.array(d + b.start)), pa.array([names[i] for i in s], pa.string()), pa.array(n[d, s] / any_subject[d])]
                    columns += [pa.array(x.astype(np.int32)) for x in (n[d, s], any_subject[d])]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


class SubjectModel:
    """A fitted model: subject names, log-odds per bucket and the steepness of each subject's calibration curve."""

    def __init__(self, names: list[str], weights: Weights, bits: int):
        self.names, self.weights, self.bits = names, weights, bits
        self.slopes: dict[str, float] = {}


def fit_slope(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> float:
    """The slope of P(y) = 1 / (1 + exp(-ax)), at least a little above 0, by Newton's method with a small ridge."""
    a = 12.0
    if not len(x) or y.min() == y.max():
        return a
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x, -30, 30)))
        step = ((y - p) @ x - ridge * a) / ((p * (1 - p)) @ (x * x) + ridge)
        a = min(max(a + step, 0.1), 200.0)
        if abs(step) < 1e-6:
            break
    return float(a)


def prepare(docs: DataFrame, labels: DataFrame, names: list[str], *, doc_id: str, text: str, lang: str | None, bits: int) -> tuple[DataFrame, int]:
    """The word lists of every document, with its label numbers, or those held out, written once to the shared folder; and
    the number of languages told apart."""
    number = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    known = labels.select(F.col(doc_id).alias("__doc"), F.try_element_at(number, F.col("subject")).alias("__n")).where("__doc is not null and __n is not null")
    per_doc = known.groupBy("__doc").agg(F.sort_array(F.collect_set("__n")).alias("labels"))
    language = F.col(lang) if lang else F.lit(None).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.nullif(F.trim(language), F.lit("")).alias("lang")).where(F.length("text") > 0)
    named = sorted(r[0] for r in bounded_rows(rows.select("lang").where("lang is not null").distinct(), MOST_LANGUAGES, "the languages"))
    languages = named + [x for x in FUNCTION_WORDS if x not in named]
    joined = rows.join(per_doc, rows["doc_id"] == per_doc["__doc"], "left")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    joined = joined.select("doc_id", "text", "lang", F.when(~held, F.col("labels")).alias("labels"), F.when(held, F.col("labels")).alias("held"))
    kind = dict(rows.dtypes)["doc_id"]
    return cut(joined.mapInArrow(_featurise(bits, languages), f"doc_id {kind}, words array<int>, lengths array<int>, lang int, labels array<int>, held array<int>")), len(languages)


def fit(features: DataFrame, n_lang: int, names: list[str], *, rounds: int, bits: int) -> SubjectModel:
    """Fit on labelled documents, then ``rounds`` of expectation-maximisation over all documents."""
    sc, k = features.sparkSession.sparkContext, len(names)
    weights, known = _gather(features, bits, k, n_lang, None)
    first = NO_SUBJECT * known / (known + HALF_KNOWN)
    for i in range(rounds):
        shared = sc.broadcast(weights)  # bounded by MODEL_BYTES
        weights, _ = _gather(features, bits, k, n_lang, shared, first + (NO_SUBJECT - first) * min(1.0, i / 3))
        shared.unpersist()
    return SubjectModel(names, weights, bits)


def shares(features: DataFrame, model: SubjectModel) -> DataFrame:
    """(doc_id, subject, share, n_sentences, n_any) for each subject with at least one sentence."""
    sc, kind = features.sparkSession.sparkContext, dict(features.dtypes)["doc_id"]
    id_type = to_arrow_type(features.schema["doc_id"].dataType)
    schema = pa.schema([("doc_id", id_type), ("subject", pa.string()), ("share", pa.float64()), ("n_sentences", pa.int32()), ("n_any", pa.int32())])
    return features.mapInArrow(_shares(sc.broadcast(model.weights), model.names, schema), f"doc_id {kind}, subject string, share double, n_sentences int, n_any int")


def calibrate(found: DataFrame, features: DataFrame, model: SubjectModel, threshold: float, *, max_labelled: int = 200_000) -> SubjectModel:
    """Fit each subject's steepness to the labelled documents held out of the fit (a sample of at most ``max_labelled``, by
    hash of the id)."""
    labelled = features.where("held is not null").select("doc_id", "held").orderBy(F.xxhash64("doc_id")).limit(max_labelled)
    pairs = labelled.join(found, "doc_id", "left").groupBy("doc_id").agg(F.first("held").alias("held"), F.collect_list(F.struct("subject", "share")).alias("s")).select("held", "s").collect()
    for i, name in enumerate(model.names):
        x = np.array([next((v["share"] for v in r["s"] if v["subject"] == name), 0.0) for r in pairs])
        y = np.array([float(i in r["held"]) for r in pairs])
        model.slopes[name] = fit_slope(x - threshold, y)
    return model


def assign_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", threshold: float = 0.25, rounds: int = 5, bits: int = 16, max_subjects: int = 1000) -> DataFrame:
    """(doc_id, subject, share, posterior): each subject whose calibrated posterior, of dealing with at least ``threshold`` of
    the subject-bearing sentences, is one half or more.

    ``labels``: (doc_id, subject); ``subjects``: the list (subject).
    """
    names = sorted(r[0] for r in bounded_rows(subjects.select("subject").where("subject is not null").distinct(), max_subjects, "the subjects"))
    kind = dict(docs.dtypes)[doc_id]
    if not names:
        return docs.sparkSession.createDataFrame([], f"`{doc_id}` {kind}, subject string, share double, posterior double")
    features, n_lang = prepare(docs, labels, names, doc_id=doc_id, text=text, lang=lang, bits=bits)
    model = fit(features, n_lang, names, rounds=rounds, bits=bits)
    found = shares(features, model)
    model = calibrate(found, features, model, threshold)
    slope = F.try_element_at(literal_map(model.slopes, "double"), F.col("subject"))
    posterior = 1 / (1 + F.exp(-slope * (F.col("share") - threshold)))
    out = found.select(F.col("doc_id").alias(doc_id), "subject", "share", posterior.alias("posterior"))
    return out.where("posterior >= 0.5")
