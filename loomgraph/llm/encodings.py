"""Restoring text that was decoded with the wrong character encoding, by description length.

UTF-8 bytes read as a one-byte encoding leave sequences of characters that, written in that
encoding, are valid UTF-8 again.  A candidate is the text after a chain of one or two such
repairs.  Its description length is the smallest size that zstandard gives with one of the
per-language dictionaries, plus a cost for every character outside the languages' alphabet
and for every seam that running text hardly has (a sign right behind a letter outside ASCII or
another kind of sign, or two scripts in one word), plus a cost for each link of the chain.  The shortest description wins, and the search goes
on from it until nothing is gained; a text that no chain shortens stays as it is.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings under which UTF-8 is misread.
CODECS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859_15")
#: Typographic characters of running text beside those of the samples.
TYPOGRAPHY = "“”‘’„‚–—…«»‹›€£°·•§±×≈≥≤→↔µ½©®™ ‍"
#: Bytes that a link of the chain costs, bytes for each letter of another script, and for each
#: other character outside the alphabet (accented capitals that the samples lack among them).
LINK_COST, LETTER_COST, ODD_COST = 2, 1, 2.5
#: Bytes for each seam.
SEAM_COST = 4
#: Symbols that stand side by side (arrows, mathematics, boxes, pictures), Latin letters, letters of other scripts.
SYMBOLS, LATIN, OTHERS = "\u2190-\u2bff\U0001f000-\U0001faff", "A-Za-z\u00c0-\u024f", "\u0370-\u1fff"
#: Most repairs of one text.
ROUNDS = 4


def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte, 0x80 to 0xFF; bytes that the encoding leaves open stand for control characters."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if codec == "cp1252":  # misreadings as Latin-1 have the control characters of all bytes below 0xA0
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


class Codec:
    """Finds and repairs the sequences that one encoding makes of UTF-8."""

    def __init__(self, name: str):
        self.name, self.byte = name, _bytes_of(name)
        cls = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in self.byte.items() if lo <= b <= hi) + "]"
        tail = cls(0x80, 0xBF)
        self.lead = re.compile(cls(0xC2, 0xF4))
        self.pattern = re.compile(f"(?:{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}})+")

    def _repair(self, m: re.Match) -> str:
        try:
            out = bytes(self.byte[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()
        # Nothing that was text turns into unassigned or enclosing characters.
        return m.group() if any(unicodedata.category(c) in ("Cn", "Co", "Me") for c in out) else out

    def repair(self, text: str) -> str:
        return self.pattern.sub(self._repair, text)


class Restorer:
    """Restores texts, given sample texts of each language for dictionaries and alphabet."""

    def __init__(self, samples: dict[str, list[str]]):
        self.codecs = [Codec(c) for c in CODECS]
        self.known = frozenset(c for texts in samples.values() for t in texts for c in t) | frozenset(TYPOGRAPHY) | frozenset(map(chr, range(32, 127))) | frozenset("\t\n\r")
        self.packers, self.costs = [], {}
        for texts in samples.values():
            words = zstandard.ZstdCompressionDict("\n".join(texts).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.packers.append(zstandard.ZstdCompressor(level=6, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False))
        self.odd = re.compile("[^\x00-\x7f]")
        sign = rf"[^\x00-\x7f\w\s{SYMBOLS}]"
        self.seam = re.compile(rf"(?<=[^\x00-\x7f]){sign}|(?<=[^\x00-\x7f{SYMBOLS}])[{SYMBOLS}]|(?<=[{OTHERS}])[{LATIN}]|(?<=[{LATIN}])[{OTHERS}]")

    def cost(self, c: str) -> float:
        """What a character costs beside its share of the packed bytes."""
        if c not in self.costs:
            foreign = c.isalpha() and ord(c) >= 0x370 and not unicodedata.name(c, "").startswith("LATIN")
            self.costs[c] = 0 if c in self.known else LETTER_COST if foreign else ODD_COST
        return self.costs[c]

    def length(self, text: str) -> float:
        data = text.encode("utf-8", "surrogatepass")
        odd = sum(self.cost(c) for c in self.odd.findall(text))
        return min(len(p.compress(data)) for p in self.packers) + odd + SEAM_COST * len(self.seam.findall(text))

    def restore(self, text: str) -> str:
        """``text`` with what was misread put right, or ``text`` itself."""
        for _ in range(ROUNDS):
            tried = {text}
            changed = [once for c in self.codecs if (once := c.repair(text)) != text]
            if not changed:
                return text
            best, least = text, self.length(text)
            for once in changed:
                if once in tried:
                    continue
                tried.add(once)
                if (n := self.length(once) + LINK_COST) < least:
                    best, least = once, n
                for second in self.codecs:
                    twice = second.repair(once)
                    if twice not in tried:
                        tried.add(twice)
                        if (n := self.length(twice) + 2 * LINK_COST) < least:
                            best, least = twice, n
            if best == text:
                return text
            text = best
        return text

    def verdict(self, text: str) -> tuple[bool, str | None]:
        """Whether ``text`` is affected, and what it was; null where characters are lost."""
        if "�" in text:
            return True, None
        fixed = self.restore(text)
        return fixed != text, fixed


def restore_texts(df: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ``fixed`` string, ``lost`` boolean) of the affected texts.

    ``samples`` (lang, text) is a small, fixed table of clean texts.  ``fixed`` is the whole
    restored text, null where original characters are lost (``lost``).

    Defined cases: null, empty and plain ASCII texts are not affected; texts without a
    shorter description are left out; repeated rows and null keys are kept; very long texts
    are handled whole; empty tables give no rows (without samples, dictionaries are empty);
    other columns are ignored.
    """
    by: dict[str, list[str]] = {}
    for r in samples.filter(F.col("text").isNotNull()).select("lang", "text").orderBy("lang", "text").collect():
        by.setdefault(r.lang or "", []).append(r.text)
    by = by or {"": [" "]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(by)
        for b in batches:
            verdicts = [restorer.verdict(t) for t in b.column(1).to_pylist()]
            hit = [i for i, v in enumerate(verdicts) if v[0]]
            fixed = [verdicts[i][1] for i in hit]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit, pa.int64())), pa.array(fixed, pa.string()), pa.array([f is None for f in fixed], pa.bool_())], names=["k", "fixed", "lost"])

    # A misread character is at least two characters outside ASCII in a row.
    suspects = df.filter(F.col(text).rlike(r"[^\x00-\x7f]{2}|\x{FFFD}")).select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = df.schema[key].dataType.simpleString()
    return suspects.mapInArrow(run, f"k {kind}, fixed string, lost boolean").select(F.col("k").alias(key), "fixed", "lost")


def md5_hex(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def p10_found(spark, sf_dir):
    from loomgraph.session import table

    found = restore_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))
    return found.select("doc_id", F.coalesce(F.md5(F.col("fixed").cast("binary")), F.lit("")).alias("fixed_md5")).distinct()


QUERIES = {"p10_found": p10_found}
ORACLES: dict[str, str] = {}
