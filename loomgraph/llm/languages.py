"""Languages of texts, mixed ones included, by expectation-maximisation over n-grams.

A letter model (trigrams backed off to bigrams and letters) of each language comes from the
clean samples.  A text is cut at sentence ends and line ends into units, and each gets a
likelihood under every language.  Expectation-maximisation estimates the text's language
proportions from them; languages leave the set as long as the penalised likelihood gains.
Within the set, the likeliest sequence of unit languages (changes have a cost) gives the
segments, and a language belongs to the text if it has a run that is long enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import strip_space

#: Characters of a run that make its language one of the text's; letters without which a text is no case.
RUN_CHARS, MIN_LETTERS = 120, 40
#: Log-likelihood that a further language of a text, and a change between units, has to gain.
LANGUAGE_COST, CHANGE_COST = 12.0, 6.0
#: The language of a text in letters that the samples don't have.
UNKNOWN = "und"
#: Labels of the languages.
LABELS = {
    "en": ["en", "eng", "english", "englisch", "anglais", "inglés"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "alemán"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "französisch", "francés"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol"],
    "it": ["it", "ita", "italian", "italiano", "italienisch", "italien"],
    "pt": ["pt", "por", "portuguese", "português", "portugues", "portugiesisch", "portugais"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "niederländisch", "néerlandais"],
}

_UNIT = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)|\n+|[.!?]|$)\s*")


def label_language(label: Column) -> Column:
    """The two-letter language that a label names (``EN``, ``deu``, ``fr-FR``, ``Spanish``), else null."""
    table = F.create_map(*[F.lit(x) for code, names in LABELS.items() for n in names for x in (n, code)])
    bare = F.lower(strip_space(label))
    return F.coalesce(F.try_element_at(table, bare), F.try_element_at(table, F.regexp_extract(bare, r"^(\p{L}+)[-_ (]", 1)))


class LetterModel:
    """Trigram scores of letters for each language, from (language, text) samples."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.langs = sorted({s[0] for s in samples})
        letters = sorted({c for _, t in samples for c in t.lower() if c.isalpha() and len(c) == 1})
        self.size = a = len(letters) + 1  # 0 stands for what is between words
        self.code = np.zeros(0x250, dtype=np.int64)
        known = {c: i + 1 for i, c in enumerate(letters)}
        for c in range(0x250):
            self.code[c] = known.get(chr(c).lower(), 0)
        self.table = np.zeros((a**3, len(self.langs)), dtype=np.float32)
        for j, lang in enumerate(self.langs):
            tri = np.zeros(a**3)
            for _, t in (s for s in samples if s[0] == lang):
                tri += np.bincount(self._trigrams(self.codes(t)), minlength=a**3)
            tri = tri.reshape(a, a, a)
            tri[:, :, 0] = 0
            bi, uni = tri.sum(0), tri.sum((0, 1))
            p1 = (uni + 0.5) / (uni + 0.5)[1:].sum()
            p2 = (bi + 4 * p1) / (bi.sum(1, keepdims=True) + 4)
            p3 = (tri + 2 * p2) / (tri.sum(2, keepdims=True) + 2)
            self.table[:, j] = np.log(p3).reshape(-1)
        self.table.reshape(a, a, a, -1)[:, :, 0] = 0  # spaces and other characters tell nothing

    def codes(self, text: str) -> np.ndarray:
        u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return np.where(u < 0x250, self.code[np.minimum(u, 0x24F)], 0)

    def _trigrams(self, codes: np.ndarray) -> np.ndarray:
        padded = np.concatenate([[0, 0], codes])
        return (padded[:-2] * self.size + padded[1:-1]) * self.size + padded[2:]

    def scores(self, text: str, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood of the units of ``text`` that end at ``ends``, by language."""
        idx = self._trigrams(self.codes(text))
        starts = np.concatenate([[0], ends[:-1]])
        out = np.zeros((len(ends), len(self.langs)))
        for lo in range(0, len(ends), 4_096):  # bounds the memory for very long texts
            s, e = starts[lo], ends[min(lo + 4_096, len(ends)) - 1]
            out[lo : lo + 4_096] = np.add.reduceat(self.table[idx[s:e]].astype(np.float64), starts[lo : lo + 4_096] - s)
        return out


def units_of(text: str) -> np.ndarray:
    """Where the units of ``text`` end: after sentence ends and line ends with the space behind."""
    ends = [m.end() for m in _UNIT.finditer(text) if m.end() > m.start()]
    return np.array(ends or [len(text)], dtype=np.int64)


def enough_letters(text: str, least: int = MIN_LETTERS) -> bool:
    """Whether ``text`` has that many letters; most texts show it early."""
    return sum(map(str.isalpha, text[: 8 * least])) >= least or sum(map(str.isalpha, text)) >= least


def mixture(ll: np.ndarray, keep: list[int], rounds: int = 12) -> tuple[np.ndarray, float]:
    """Proportions of the languages ``keep`` by expectation-maximisation, and the log-likelihood."""
    x = ll[:, keep]
    top = x.max(axis=1, keepdims=True)
    w, pi = np.exp(np.maximum(x - top, -200)), np.full(len(keep), 1 / len(keep))
    for _ in range(rounds):
        post = w * pi
        post /= post.sum(axis=1, keepdims=True)  # the best language of a unit has w = 1, so no sum is 0
        last, pi = pi, np.maximum(post.sum(axis=0) / len(w), 1e-6)
        pi /= pi.sum()
        if np.abs(pi - last).max() < 1e-3:
            break
    return pi, float((np.log(np.maximum((w * pi).sum(1), 1e-300)) + top[:, 0]).sum())


def language_set(ll: np.ndarray) -> list[int]:
    """Columns of the languages that the penalised likelihood selects."""
    best_of = np.bincount(ll.argmax(axis=1), minlength=ll.shape[1])
    keep = [i for i in np.argsort(-best_of) if best_of[i]]
    # A language can't gain more than where it beats all others that are left; most need no further look.
    while len(keep) > 1:
        x = ll[:, keep]
        order = np.sort(x, axis=1)
        gain = np.where(x == order[:, -1:], x - order[:, -2:-1], 0).sum(0)
        if gain.min() >= LANGUAGE_COST:
            break
        keep = [k for i, k in enumerate(keep) if i != int(gain.argmin())]
    if len(keep) == 1:
        return keep
    pi, whole = mixture(ll, keep)
    while len(keep) > 1:
        for i in np.argsort(pi):  # the rarest that may go
            rest = [k for k in keep if k != keep[i]]
            of_rest, less = mixture(ll, rest)
            if whole - less < LANGUAGE_COST:
                keep, pi, whole = rest, of_rest, less
                break
        else:
            break
    return keep


def likeliest_path(ll: np.ndarray) -> np.ndarray:
    """The column of each unit in the likeliest sequence, where a change costs CHANGE_COST."""
    n, m = ll.shape
    back, score = np.zeros((n, m), dtype=np.int64), ll[0].copy()
    for i in range(1, n):
        j = int(score.argmax())
        jump = score[j] - CHANGE_COST
        stay = score >= jump
        back[i] = np.where(stay, np.arange(m), j)
        score = np.where(stay, score, jump) + ll[i]
    out = np.empty(n, dtype=np.int64)
    out[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def detect(model: LetterModel, text: str) -> tuple[list[tuple[str, float]], list[tuple[int, int, str, float]]]:
    """((language, confidence) of the text, (start, end, language, confidence) of its segments).

    A text most of whose letters occur in no sample is UNKNOWN, with their share as confidence.
    """
    strange = sum(map(str.isalpha, filter(lambda c: c > "\u024f", text)))
    if strange and strange > (known := int(np.count_nonzero(model.codes(text)))):
        share = strange / (strange + known)
        return [(UNKNOWN, share)], [(0, len(text), UNKNOWN, share)]
    ends = units_of(text)
    ll = model.scores(text, ends)
    keep = sorted(language_set(ll))
    path = likeliest_path(ll[:, keep]) if len(keep) > 1 else np.zeros(len(ends), dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    cuts = np.flatnonzero(path[1:] != path[:-1]) + 1
    segments, longest, weight = [], {}, {}
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(path)]])):
        s, e, j = int(starts[a]), int(ends[b - 1]), keep[path[a]]
        total = ll[a:b].sum(0)
        conf = float(1 / np.exp(np.minimum(total - total[j], 50)).sum())
        segments.append((s, e, model.langs[j], conf))
        run = len(text[s:e].strip())
        longest[j] = max(longest.get(j, 0), run)
        weight[j] = max(weight.get(j, 0.0), conf)
    own = [j for j, n in longest.items() if n >= RUN_CHARS] or [max(longest, key=longest.get)]
    return [(model.langs[j], weight[j]) for j in sorted(own)], segments


def detect_languages(df: DataFrame, samples: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(``key``, ``langs`` array<struct<lang, confidence>>, ``segments`` array<struct<start, end, lang, confidence>>).

    ``samples`` (lang, text) is a small, fixed table.  Offsets count characters.

    Defined cases: null texts and texts of fewer than 40 letters give no row; repeated rows
    and null keys are kept; very long texts are read whole; a text in letters unknown to the
    samples has the language UNKNOWN; without samples there are no rows; other columns are
    ignored.
    """
    known = [(r.lang, r.text) for r in samples.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").collect()]
    kind = df.schema[key].dataType.simpleString()
    schema = f"k {kind}, langs array<struct<lang:string,confidence:double>>, segments array<struct<start:long,end:long,lang:string,confidence:double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = LetterModel(known)
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"]):
                if enough_letters(t):
                    langs, segments = detect(model, t)
                    rows.append((k, [{"lang": x, "confidence": c} for x, c in langs], [{"start": s, "end": e, "lang": x, "confidence": c} for s, e, x, c in segments]))
            yield pd.DataFrame(rows, columns=["k", "langs", "segments"])

    some = df.filter(F.length(text) >= MIN_LETTERS) if known else df.limit(0)
    return some.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, schema).withColumnRenamed("k", key)


def _items(spark, sf_dir: str) -> DataFrame:
    """(item_id, label, text): documents, and the latest version of each summary record."""
    from loomgraph.session import table

    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("item_id"), "lang", "text", F.lit(True).alias("labelled"))
    records = table(spark, sf_dir, "vector_records").filter(F.col("kind") == "doc_summary")
    latest = records.groupBy("id").agg(F.max(F.struct("created_at", "text")).alias("m")).select(F.col("id").alias("item_id"), F.lit(None).cast("string").alias("lang"), "m.text", F.lit(False).alias("labelled"))
    return docs.unionByName(latest)


def p5_found(spark, sf_dir):
    from loomgraph.session import table

    items = _items(spark, sf_dir).withColumn("key", F.struct("item_id", "labelled", label_language(F.col("lang")).alias("label")))
    found = detect_languages(items, table(spark, sf_dir, "lang_samples"), "key").select("key.*", F.col("langs.lang").alias("langs"))
    wrong = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))
    return found.filter(~F.col("labelled") | wrong).select("item_id", F.explode("langs").alias("lang")).filter(F.col("lang") != UNKNOWN).distinct()


def p5_segments(spark, sf_dir):
    from loomgraph.session import table

    found = detect_languages(_items(spark, sf_dir), table(spark, sf_dir, "lang_samples"), "item_id")
    return found.select("item_id", F.explode("segments").alias("s")).select(
        "item_id", F.col("s.start").alias("seg_start"), F.col("s.end").alias("seg_end"), F.col("s.lang").alias("lang"), F.round("s.confidence", 6).alias("confidence")
    )


QUERIES = {"p5_found": p5_found, "p5_segments": p5_segments}
ORACLES: dict[str, str] = {}
