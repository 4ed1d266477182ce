"""Free-entered names to the entries of a reference list, by token-level repair and soft TF-IDF.

1. Each distinct token of the names is joined to the reference vocabulary by edit distance: both sides are expanded to
   their deletion neighbourhoods, which meet in an equi-join wherever the distance is within the bound, and the true
   distance is then verified. Abbreviations (a subsequence from the same first letter) are added for common words.
2. The corrected tokens of each distinct name are combined: the soft TF-IDF cosine between the name and every entry that
   shares a distinctive token ranks the entries. A name stands for the first entry if its score is at least
   ``LEAST_SCORE`` and no other entry has the same. Of a name in parts (an office after a dash, a second name after
   'trading as') the first part that stands for an entry decides.

Only distinct tokens and distinct names are worked on; rows are joined back by name, and the rows of a name that many
bear are spread over partitions. The reference list must be small (``max_entries``), which is checked.

Defined cases: a null or empty name gives no row; a name of punctuation alone, or of words the list doesn't hold, is
unmatched (-1); a tie between two different entries is unmatched; repeated rows give repeated rows; an empty reference
list leaves everything unmatched; a token longer than every listed word by more than two letters has no repair.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerquarry.functions.text import bound
from ledgerquarry.runtime import bounded_rows, cut, default_partitions, hot_keys, join_spread

UNMATCHED = -1
# Words that say nothing about which firm it is.
LEGAL_WORDS = ("pty", "ltd", "limited", "proprietary", "inc", "co", "p", "l", "the", "aust", "group", "abn", "and", "pl", "company")
PLACE_WORDS = ("head", "office", "accounts", "dept", "department", "north", "south", "east", "west", "yard", "bay", "depot", "branch", "warehouse")
# Letters that scanners read as digits.
SCANNED, MEANT = "01569|", "olsbgl"
LOOKALIKE = str.maketrans(SCANNED, MEANT)
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüçñÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑ"
UNACCENTED = "aaaaaaeeeeiiiiooooouuuucnAAAAAAEEEEIIIIOOOOOUUUUCN"
#: The least soft TF-IDF cosine of a name and the entry it stands for.
LEAST_SCORE = 0.72
#: What an entry's word that the name leaves out weighs in the entry's length: names are often shortened.
LEFT_OUT = 0.3
#: What parts a name: a dash between blanks, or words that introduce another name of the same firm.
PARTS = r"(?i)\s+[-–—]\s+|\s+t/as?\s+|\s+trading as\s+"


def plain(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


def name_tokens(c: Column) -> Column:
    """Lower-case words without accents; a capital after a small letter begins a word; apostrophes join, other signs
    part; a number is no word."""
    parted = F.regexp_replace(F.translate(c, ACCENTED, UNACCENTED), "([a-z])([A-Z])", "$1 $2")
    words = F.split(F.regexp_replace(F.lower(F.regexp_replace(parted, "[’'`]", "")), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: w.rlike("[a-z]"))


def allowed_edits(word: str, common: bool) -> int:
    """Edits allowed to a vocabulary word: a code or very short word must be exact; in words run together, one."""
    n = len(word)
    return 1 if n > 20 else 2 if n >= 8 else 1 if n >= (4 if common else 6) else 0


def deletion_forms(word: Column, edits: Column) -> Column:
    """Hashes of the word and of what is left of it without one, or one or two letters; within the JVM."""
    without = lambda w, i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))
    places = lambda w, first: F.when(F.length(w) >= first, F.sequence(first, F.length(w))).otherwise(F.array().cast("array<int>"))
    one = F.transform(places(word, F.lit(1)), lambda i: without(word, i))
    two = F.flatten(F.transform(places(word, F.lit(1)), lambda i: bound(without(word, i), lambda w: F.transform(places(w, i), lambda j: without(w, j)))))
    forms = F.when(edits <= 0, F.array(word)).when(edits == 1, F.concat(F.array(word), one)).otherwise(F.concat(F.array(word), one, two))
    return F.array_distinct(F.transform(forms, lambda f: F.xxhash64(f)))


def repair_tokens(tokens: DataFrame, vocabulary: list[tuple[str, bool]]) -> DataFrame:
    """(token, word, sim): the vocabulary words within the allowed edits of each distinct token.

    ``vocabulary``: words with a flag for common ones, which may be abbreviated. An equi-join on deletion forms finds
    every pair within two edits; the distance is then computed, so nothing beyond the bound passes. Two letters
    exchanged are one edit; signs that scanners confuse (0/o, 1/l, 5/s, 6/b, 9/g) are none. The vocabulary comes from the
    bounded reference list, so its common words are sent to every worker.
    """
    spark = tokens.sparkSession
    words = sorted({(w, allowed_edits(w, c)) for w, c in vocabulary})
    # Tokens are few bytes and much work: they are spread by a number, which Spark does not shrink for their size.
    n = default_partitions(spark)
    longest = max((len(w) for w, _ in words), default=0) + 2
    known = spark.createDataFrame(pa.table({"word": pa.array([w for w, _ in words], pa.string()), "edits": pa.array([e for _, e in words], pa.int32())})).repartition(n, "word")
    known = known.select("word", "edits", F.explode(deletion_forms(F.translate("word", SCANNED, MEANT), F.col("edits"))).alias("form"))
    folded = F.translate("token", SCANNED, MEANT)
    asked = tokens.where(F.length("token") <= longest).repartition(n, "token").select("token", F.explode(deletion_forms(folded, F.when(F.length("token") >= 6, 2).otherwise(1))).alias("form"))
    # Both sides grow with their tables, and Spark can't estimate what they expand to: they are never broadcast.
    near = asked.join(known.hint("merge"), "form").select("token", "word", "edits").distinct()
    letters = lambda c: F.array_sort(F.split(c, ""))
    d = F.levenshtein(folded, F.col("word"))
    swapped = (d == 2) & (F.length("token") == F.length("word")) & (letters(folded) == letters(F.col("word")))
    near = near.withColumn("d", F.when(swapped, 1).otherwise(d)).where("d <= edits").select("token", "word", (1 - F.col("d") / F.greatest(F.length("token"), F.length("word"))).alias("sim"))
    common = [w for w, c in vocabulary if c and len(w) >= 5]
    heads = spark.createDataFrame(pa.table({"head": pa.array([w[0] for w in common], pa.string()), "word": pa.array(common, pa.string())}))
    # A subsequence from the same first letter: the pattern 'svcs' -> 's.*v.*c.*s.*'.
    shorter = tokens.withColumn("head", F.substring("token", 1, 1)).join(F.broadcast(heads), "head").where((F.length("token") >= 3) & (F.length("token") < F.length("word")))
    short = shorter.where(F.col("token").rlike("^[a-z]+$")).where(F.expr("word rlike concat('^', regexp_replace(token, '(.)', '$1.*'))")).select("token", "word", F.when(F.expr("startswith(word, token)"), 0.95).otherwise(0.85).alias("sim"))
    return near.unionByName(short).groupBy("token", "word").agg(F.max("sim").alias("sim"))


class Reference:
    """The reference list as entries of tokens with IDF weights. Bounded by the caller's check."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.entries: list[tuple[int, list[str]]] = []
        for entry_id, names in rows:
            for name in names:
                if words := self.words(name):
                    self.entries.append((entry_id, words))
        holders: dict[str, set[int]] = defaultdict(set)
        for entry_id, words in self.entries:
            for w in words:
                holders[w].add(entry_id)
        self.n = max(1, len({e for e, _ in self.entries}))
        self.idf = {w: math.log(1 + self.n / len(h)) for w, h in holders.items()}
        first = Counter(words[0] for _, words in self.entries)
        self.common = {w for w, h in holders.items() if w not in first}
        self.unknown = math.log(1 + self.n)
        self.joined: dict[str, tuple[str, ...]] = {}
        for _, words in self.entries:
            if len(words) > 1:
                for order in (words, words[1:] + words[:1]):
                    for k in range(2, len(order) + 1):
                        self.joined.setdefault("".join(order[:k]), tuple(order[:k]))
        self.by_word: dict[str, list[int]] = defaultdict(list)
        for i, (_, words) in enumerate(self.entries):
            for w in set(words):
                if w not in self.common:
                    self.by_word[w].append(i)

    @staticmethod
    def words(name: str) -> list[str]:
        text = re.sub(r"[’'`]", "", plain(name or ""))
        found = [w for w in re.split(r"[^a-z0-9]+", text) if re.search("[a-z]", w)]
        kept = [w for w in found if w not in LEGAL_WORDS]
        # 'Company' and place words identify a firm where they belong to its listed name.
        return [w for w in found if w not in LEGAL_WORDS or (w == "company")] if kept else found

    def vocabulary(self) -> list[tuple[str, bool]]:
        words = [(w, w in self.common) for w in self.idf]
        return words + [(j, False) for j in self.joined if j not in self.idf]

    def rank(self, tokens: list[str], repairs: dict[str, list[tuple[str, float]]]) -> tuple[int, float]:
        """The entry this name stands for, and the soft TF-IDF cosine; (-1, best score) if none."""
        ways: list[tuple[str, list[tuple[tuple[str, ...], float]]]] = []
        for t in tokens:
            ways.append((t, [(self.joined.get(w, (w,)) if w not in self.idf else (w,), s) for w, s in repairs.get(t, [])]))
        best: dict[int, float] = {}
        for i in {i for _, options in ways for words, _ in options for w in words for i in self.by_word.get(w, ())}:
            entry_id, words = self.entries[i]
            inside, hit = set(words), set()
            dot = norm = 0.0
            for t, options in ways:
                fitting = [(s, ws) for ws, s in options if all(w in inside for w in ws)]
                if fitting:
                    s, ws = max(fitting)
                    norm += sum(self.idf[w] ** 2 for w in ws)
                    dot += s * sum(self.idf[w] ** 2 for w in ws if w not in hit)
                    hit |= set(ws)
                elif t not in LEGAL_WORDS and t not in PLACE_WORDS:
                    known = [self.idf[w] for ws, s in options for w in ws if s > 0.8]
                    # A fragment of one or two letters is scanning debris unless it is the whole name.
                    norm += ((max(known) if known else self.unknown) * (0.2 if len(t) <= 2 else 1.0)) ** 2
            if hit and not all(w in self.common for w in hit):
                length = sum(self.idf[w] ** 2 * (1.0 if w in hit else LEFT_OUT) for w in inside)
                score = dot / math.sqrt(norm * length)
                best[entry_id] = max(score, best.get(entry_id, 0.0))
        ranked = sorted(best.items(), key=lambda kv: (-round(kv[1], 6), kv[0]))
        if not ranked:
            return UNMATCHED, 0.0
        (entry_id, score), others = ranked[0], ranked[1:]
        tied = bool(others) and abs(others[0][1] - score) < 1e-6
        return (UNMATCHED if tied or score < LEAST_SCORE else entry_id), score

    def rank_parts(self, parts: list[list[str]], repairs: dict[str, list[tuple[str, float]]]) -> tuple[int, float]:
        """The first part that stands for an entry; (-1, best score) if none does."""
        scores = []
        for tokens in parts:
            entry_id, score = self.rank(list(tokens), repairs)
            if entry_id != UNMATCHED:
                return entry_id, score
            scores.append(score)
        return UNMATCHED, max(scores, default=0.0)


def _ranker(reference: Reference):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, scores = [], []
            for parts, found in zip(pdf["parts"], pdf["repairs"]):
                repairs: dict[str, list[tuple[str, float]]] = defaultdict(list)
                for r in found if found is not None else ():
                    repairs[r["token"]].append((r["word"], r["sim"]))
                entry, score = reference.rank_parts(parts, repairs)
                ids.append(entry)
                scores.append(score)
            yield pd.DataFrame({"name": pdf["name"], "entry_id": ids, "score": scores})

    return run


def map_names(df: DataFrame, id_col: str, name_col: str, entries: DataFrame, entry_id: str, entry_name: str, entry_aliases: str | None = None, *, max_entries: int = 200_000) -> DataFrame:
    """(id, entry_id, score) for each row with a name; entry_id -1 where no entry is meant.

    ``entries`` is the reference list, collected under a checked bound. Shuffles: distinct tokens, distinct names, and
    the join back by name.
    """
    aliases = F.col(entry_aliases) if entry_aliases else F.array().cast("array<string>")
    listed = bounded_rows(entries.select(F.col(entry_id).cast("bigint"), F.concat(F.array(F.col(entry_name)), F.coalesce(aliases, F.array().cast("array<string>")))), max_entries, "the reference list")
    reference = Reference([(r[0], [n for n in r[1] if n]) for r in listed])
    rows = df.select(F.col(id_col).alias("__id"), F.col(name_col).alias("name")).where(F.length(F.trim("name")) > 0)
    counts = cut(rows.groupBy("name").agg(F.count("*").alias("n")))
    names = cut(counts.select("name", F.transform(F.split("name", PARTS), name_tokens).alias("parts")))
    tokens = cut(names.select(F.explode(F.array_distinct(F.flatten("parts"))).alias("token"), "name"))
    repairs = repair_tokens(tokens.select("token").distinct(), reference.vocabulary())
    per_name = tokens.join(repairs, "token").groupBy("name").agg(F.collect_list(F.struct("token", "word", "sim")).alias("repairs"))
    ranked = names.join(per_name, "name", "left").select("name", "parts", "repairs").repartition(default_partitions(df.sparkSession), F.xxhash64("name")).mapInPandas(_ranker(reference), "name string, entry_id bigint, score double")
    return join_spread(rows, ranked, ["name"], hot_keys(counts, ["name"], "n"), F.col("__id")).select(F.col("__id").alias(id_col), "entry_id", "score")
