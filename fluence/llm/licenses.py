"""Licence scans: short notices found with a bounded number of edits.

A notice of m characters that may hold k edits is cut into k + 1 pieces; at least one must stand unchanged (pigeonhole).
Exact search for the pieces locates candidates, and the regex library's bounded-error matching confirms each one, with its
edits and its place. Texts are compared as words: lower case, anything between words counts as one space. The words that
tell one licence from another (names, versions) are marked in a notice: short ones must stand unchanged, long ones within
one edit, so edits fall on the common wording. Where places of several notices overlap, the nearest one is reported.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import TO_WORDS, slices

# Phrases that count where their words stand unchanged, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Short notices and their labels. What stands in braces tells licences apart.
NOTICES = [
    ("licensed under the {apache} license version {2 0}", "apache-2.0"),
    ("licensed under the {apache} license version {1 1}", "apache-1.1"),
    ("released under the {mit} license", "mit"),
    ("licensed under the {mit} license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("released under the {bsd} license", "bsd"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("released under the {gpl} license", "gpl"),
    ("licensed under {cc by 4 0}", "cc-by-4.0"),
    ("licensed under {cc by sa 4 0}", "cc-by-sa-4.0"),
    ("licensed under {cc by nc 4 0}", "cc-by-nc-4.0"),
    ("licensed under {cc by nd 4 0}", "cc-by-nd-4.0"),
    ("creative commons attribution {sharealike}", "cc-by-sa"),
    ("creative commons attribution {noncommercial}", "cc-by-nc"),
    ("creative commons {zero} {universal} public domain dedication", "cc0"),
    ("{gnu} general public license version {2}", "gpl-2.0"),
    ("{gnu} general public license version {3}", "gpl-3.0"),
    ("{gnu} {lesser} general public license", "lgpl"),
    ("{gnu} {affero} general public license", "agpl"),
    ("{mozilla} public license version {1 1}", "mpl-1.1"),
    ("{mozilla} public license version {2 0}", "mpl-2.0"),
    ("{eclipse} public license version {1 0}", "epl-1.0"),
    ("{eclipse} public license version {2 0}", "epl-2.0"),
    ("{boost} software license version {1 0}", "bsl-1.0"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "reserved"),
]
#: One edit for each so many characters of a notice, at most four; a marked word of so many characters may hold one.
CHARS_PER_EDIT = 10
MOST_EDITS = 4
LONG_NAME = 6


def plain(notice: str) -> str:
    return notice.replace("{", "").replace("}", "")


def edits_allowed(notice: str) -> int:
    return min(MOST_EDITS, len(plain(notice)) // CHARS_PER_EDIT)


def parts(notice: str) -> list[tuple[str, int]]:
    """The notice in parts that cover it, each with the edits that it may hold."""
    k, out = edits_allowed(notice), []
    for i, stretch in enumerate(notice.replace("}", "{").split("{")):
        if i % 2 == 0:
            out += [(stretch, k)] if stretch.strip() else [(stretch, 0)] if stretch else []
        else:
            for j, word in enumerate(stretch.split(" ")):
                out += ([(" ", 0)] if j else []) + [(word, min(k, int(len(word) >= LONG_NAME)))]
    return out


def pieces(notice: str) -> list[tuple[int, bytes]]:
    """k + 1 pieces that cover the notice, each with its offset."""
    text, k = plain(notice), edits_allowed(notice) + 1
    cuts = [len(text) * i // k for i in range(k + 1)]
    return [(a, text[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]


def pattern_of(notice: str) -> regex.Pattern:
    """Whole words, marked ones too, within the edits of every part; the best match counts. Edits in all are for the caller."""
    inner = ""
    for i, (p, k) in enumerate(parts(notice)):
        edge = "(?<=[ \\n])" if i and parts(notice)[i - 1][0].endswith(" ") else ""  # nothing is put before a marked word
        after = "(?=[ \\n])" if not p.endswith(" ") else ""
        inner += f"{edge}(?:{regex.escape(p, literal_spaces=True)})" + (f"{{e<={k}}}" if k else "") + after
    return regex.compile(f"(?b)(?<=[ \\n]){inner}(?=[ \\n])".encode())


def nearest(found: list[tuple]) -> list[tuple]:
    """Of places (first, last, label, edits, length) that overlap, the one with the fewest edits a character; of equal ones
    the longest, then the first. Ordered by place."""
    out: list[tuple] = []  # by place; as none overlap, a new one can only meet its two neighbours
    for x in sorted(found, key=lambda x: (x[3] / x[4], -x[4], x)):
        at = bisect_left(out, x[:2])
        if (at == 0 or out[at - 1][1] <= x[0]) and (at == len(out) or x[1] <= out[at][0]):
            out.insert(at, x)
    return out


class Scanner:
    def __init__(self, notices=NOTICES, phrases=PHRASES):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = [(len(plain(n)), label, edits_allowed(n), pieces(n), pattern_of(n)) for n, label in notices]

    def texts(self, raw: bytes, off: list[int]):
        """For each text: words; phrase places (start word, label); notice places (start word, end word, label, edits, length)."""
        lines, counts = [], []
        for a, b in zip(off, off[1:], strict=False):
            words = raw[a:b].translate(TO_WORDS).split()
            counts.append(len(words))
            lines.append(b" ".join(words))
        whole = b"\n" + b"".join(b" " + x + b" \n" for x in lines)
        begin = np.cumsum([1] + [len(x) + 3 for x in lines]).tolist()
        spaces = None
        phrases: list[list] = [[] for _ in lines]
        found: list[set] = [set() for _ in lines]

        def word_at(doc: int, at: int) -> int:
            """How many spaces stand between the beginning of the text's line and a place."""
            nonlocal spaces
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
            return int(np.searchsorted(spaces, at) - np.searchsorted(spaces, begin[doc]))

        for needle, label in self.phrases:
            at = whole.find(needle)
            while at >= 0:
                doc = bisect_right(begin, at) - 1
                phrases[doc].append((word_at(doc, at), label))
                at = whole.find(needle, at + 1)
        for size, label, k, parts, pattern in self.notices:
            for offset, part in parts:
                at = whole.find(part)
                while at >= 0:
                    doc = bisect_right(begin, at) - 1
                    lo, hi = max(begin[doc], at - offset - k - 1), min(begin[doc + 1] - 1, at - offset + size + k + 2)
                    for m in pattern.finditer(whole, lo, hi):
                        if sum(m.fuzzy_counts) > k:
                            continue
                        found[doc].add((word_at(doc, m.start()) - 1, word_at(doc, m.start()) + m[0].strip().count(b" "), label, sum(m.fuzzy_counts), size))
                    at = whole.find(part, at + 1)
        notices = [nearest(list(x)) for x in found]
        return counts, phrases, notices


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, phrases (word, label), notices (first, last word, label, edits, similarity).

    last is exclusive; similarity is 1 - edits / characters of the notice; of overlapping notices only the nearest is there.
    Null texts are empty; empty texts and texts without words have no places. Texts of any length are searched whole.
    Repeated rows repeat, further columns are ignored, an empty table gives no rows.
    """
    schema = "doc_id long, n_words long, phrases array<struct<word:long,label:string>>, notices array<struct<first:long,last:long,label:string,edits:int,similarity:double>>"
    one = pa.struct([("word", pa.int64()), ("label", pa.string())])
    two = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("edits", pa.int32()), ("similarity", pa.float64())])

    def run(batches):
        scanner = Scanner()
        for piece, data, off in slices(batches):
            n, phrases, notices = scanner.texts(data.tobytes(), off.tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    pa.array(n, pa.int64()),
                    pa.array([[{"word": w, "label": x} for w, x in sorted(p)] for p in phrases], pa.list_(one)),
                    pa.array([[{"first": a, "last": b, "label": x, "edits": e, "similarity": 1 - e / m} for a, b, x, e, m in sorted(p)] for p in notices], pa.list_(two)),
                ],
                names=["doc_id", "n_words", "phrases", "notices"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op5_license_scan(spark, sf_dir):
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.array_sort(F.array_distinct("phrases.label"))
    every = F.array_sort(F.array_distinct(F.concat("phrases.label", "notices.label")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.word").alias("first_word"),
        F.array_max("phrases.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max("notices.similarity"), F.lit(0.0))).alias("score"),
        "notices",
    )
