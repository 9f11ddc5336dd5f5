"""Secret scans: fixed patterns, and zstandard novelty against primed dictionaries.

Base patterns (spans in code points, end exclusive; the whole match is the span):

* ``assign``: a credential name, ``:`` or ``=``, and a value of six characters or more;
* ``access``: ``AKIA`` and upper-case letters and digits, 20 characters or more;
* ``hex``: 24 or more of ``0-9a-f``.

The method adds ``novel`` spans: a run of 16 or more token characters that touches no base span and has a sensitive
word in the ``CONTEXT`` characters before it is a candidate. Each candidate is compressed with zstandard, primed with
code words, behind its own two dictionaries: the identifiers of the corpus that it holds, and the surrounding text. Its
marginal bytes are the compressed size with the candidate less that without. A name or a phrase that the dictionaries
know costs a few bytes; a random string costs the entropy of its alphabet. It is reported if its marginal bits reach
``NOVEL`` of the bits that its alphabet could hold.

An identifier is a word of ``WORD[0]`` to ``WORD[1]`` letters, in either case, that stands by itself (no token character
beside it) at least ``KNOWN`` times in the whole corpus. Counts are exact, of every word, at every size: the word table
stays a partitioned table, and the letters of the candidates join it. Copies of a secret teach nothing, since its
letters do not stand by themselves.

Cases: null and empty texts have no span; very long texts are scanned whole; repeated rows are reported each; an
empty corpus gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilia.llm import common

# Patterns and kinds in the order of the contract.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "novel")

_ASSIGN = re.compile(ASSIGN.replace("(password", "((?i:password").replace("api_?key)", "api_?key))"), re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII)  # a maximal run: the same as all runs without the short ones
_HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|authorization", re.ASCII)
_SIGNS = ("passw", "passphrase", "secret", "token", "key", "credential", "bearer", "authorization")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.ASCII)
CODE_WORDS = ("return import from class public private static const function string number boolean null true false value "
              "config default username password secret token api_key access_key client_id client_secret authorization bearer "
              "https:// http:// .com/ localhost example placeholder changeme environment variable")
CONTEXT = 64
AROUND = 256
NOVEL = 0.85
WORD = (5, 15)  # letters of an identifier; shorter than any candidate
KNOWN = 2
SALTS = 16
TALLY = 400_000  # words counted before a task hands its counts on
_BREAKS = bytes(i if i >= 128 or _RUN.match(chr(i) * 16) else 32 for i in range(256))  # token characters stay, ASCII beside them parts
_LETTERS = re.compile(r"[A-Za-z]{%d,}" % WORD[0], re.ASCII)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): words of ``WORD`` letters that stand by themselves in the column ``text``, in lower case; each task
    sums its words before the shuffle."""
    def table(tally: Counter) -> pd.DataFrame:
        words = [w for w in tally if WORD[0] <= len(w) <= WORD[1] and w.isalpha()]
        return pd.DataFrame({"word": [w.decode() for w in words], "n": [tally[w] for w in words]}, columns=["word", "n"]).astype({"word": object, "n": "int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                tally.update(t.encode("utf-8", "replace").lower().translate(_BREAKS).split())
                if len(tally) > TALLY:
                    yield table(tally)
                    tally.clear()
        yield table(tally)

    return texts.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pieces(run: str) -> set[str]:
    """Every stretch of letters of the run that could be an identifier, as it is written there."""
    least, most = WORD
    return {m[0][i:i + n] for m in _LETTERS.finditer(run) for i in range(len(m[0]) - least + 1) for n in range(least, min(most, len(m[0]) - i) + 1)}


class Novelty:
    """Marginal compressed bytes of a string against surrounding text, the identifiers it holds and code words."""

    def __init__(self, words: bytes = CODE_WORDS.encode()):
        primed = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=9)
        self.zip = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def share(self, before: str, candidate: str, after: str, known: Iterable[str] = ()) -> float:
        """Marginal bits over the bits that the candidate's alphabet could hold; ``known``: identifiers in it."""
        names = "".join(w + " " for w in sorted(known, key=lambda w: (len(w), w)))
        around = (names + after + "\n" + before).encode("utf-8", "replace")
        extra = len(self.zip.compress(around + candidate.encode())) - len(self.zip.compress(around))
        if re.fullmatch("[0-9]+", candidate):
            size = 10
        elif re.fullmatch("[0-9a-f]+|[0-9A-F]+", candidate):
            size = 16
        elif re.fullmatch("[0-9a-z]+|[0-9A-Z]+", candidate):
            size = 36
        else:
            size = 64
        return 8 * extra / (len(candidate) * math.log2(size))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def lowered(text: str) -> str:
    """Lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str, str]]:
    """(start, end, text before, run, text after) of every run in a sensitive context that touches no base span."""
    low = lowered(text)
    if not any(s in low for s in _SIGNS):
        return []
    taken: list[list[int]] = []  # base spans as disjoint ranges
    for a, _, b in base:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    out, i = [], 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if (i == len(taken) or taken[i][0] >= b) and _SENSITIVE.search(low, max(0, a - CONTEXT), a):
            out.append((a, b, text[max(0, a - AROUND):a], m[0], text[b:b + AROUND]))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def known_words(found: DataFrame, words: DataFrame) -> DataFrame:
    """(key, start, known) of the candidates (key, start, run) that hold identifiers of the table ``words``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, start, text in zip(b["key"], b["start"], b["run"], strict=True):
                held = sorted(pieces(text))
                for i in range(0, len(held), TALLY):
                    yield pd.DataFrame({"key": key, "start": start, "piece": held[i:i + TALLY]})

    parts = found.select("key", "start", "run").mapInPandas(run, "key string, start int, piece string").withColumn("word", F.lower("piece"))
    # A word may be in most candidates: the identifiers that any of them holds are copied to every salt.
    held = words.filter(F.col("n") >= KNOWN).join(parts.select("word").distinct(), "word", "left_semi")
    salted = held.select("word", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("key", "start"), F.lit(SALTS)).cast("int"))
    return parts.join(salted, ["word", "salt"]).groupBy("key", "start").agg(F.collect_list("piece").alias("known"))


def novel(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates (key, start, end, before, run, after) that the dictionaries do not explain, as (key, start, end)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        novelty = Novelty()
        for b in batches:
            columns = (b[c] for c in ("before", "run", "after", "known"))
            fresh = [novelty.share(x, c, y, () if k is None else k) >= NOVEL for x, c, y, k in zip(*columns, strict=True)]
            yield b.loc[fresh, ["key", "start", "end"]]

    return found.join(known_words(found, words), ["key", "start"], "left").mapInPandas(run, "key string, start int, end int")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans) per row."""
    src = common.id_text(docs, id_col, text_col)
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                base = base_spans(t)
                count = Counter(k for _, k, _ in base)
                rows.append([*(count[k] for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(),
                             [dict(zip(("start", "kind", "end"), x, strict=True)) for x in base],
                             [dict(zip(("start", "end", "before", "run", "after"), x, strict=True)) for x in candidates(t, base)]])
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "base", "found"])
            out.insert(0, "doc_id", b["doc_id"].reset_index(drop=True))
            out.insert(1, "key", b["key"].reset_index(drop=True))
            yield out

    scanned = common.write_cut(src.withColumn("key", common.row_key(F.col("doc_id"), common.text_key())).mapInPandas(
        run, f"""doc_id {id_type}, key string, n_assign long, n_access long, n_hex long, base_sha256 string,
        base array<struct<start:int,kind:int,end:int>>, found array<struct<start:int,end:int,before:string,run:string,after:string>>"""))
    found = scanned.filter(F.size("found") > 0).dropDuplicates(["key"]).select("key", F.inline("found"))
    added = novel(found, word_counts(src)).groupBy("key").agg(
        F.collect_list(F.struct("start", F.lit(KINDS.index("novel")).alias("kind"), "end")).alias("added"))
    out = scanned.filter(F.size("found") > 0).join(added, "key", "left").unionByName(
        scanned.filter(F.size("found") == 0).withColumn("added", F.lit(None).cast("array<struct<start:int,kind:int,end:int>>")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    every = F.array_sort(F.concat("base", F.coalesce("added", none)))
    named = F.transform(every, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"]))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.size(F.coalesce("added", none)).cast("long").alias("n_novel"), "base_sha256",
                      F.array_join(named, ",").alias("spans"))
