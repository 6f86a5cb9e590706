"""Secret scan in DataFrame functions only: patterns, and sliding-window entropy.

Matches get their places without any Python: each is marked in the text, the text is split at
the marks, and the lengths of the parts add up. Candidate strings are then scanned for windows
of high Shannon entropy. The sum of ``c * log2(c)`` over the character counts ``c`` of a window
changes by two terms when the window moves by a character, so no window is counted anew. What
counts as high depends on the candidate's character class. Strings on the allow list, and the
ones that a pattern has found already, are not reported as entropy spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the known kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs are maximal: shorter ones are the failing matches
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters of a window, and bits a character at least by class of the candidate.
WINDOW = 20
HEX_BITS, MIXED_BITS = 3.0, 3.8
#: Candidates that hold one of these are known not to be secrets.
ALLOW = (
    r"(?i)example|sample|dummy|placeholder|changeme|xxxxxx|abcdefgh|01234567"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
)
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "entropy")

#: Marks a match. In the text itself it is replaced by a character that no pattern knows either.
_MARK, _OTHER = "\u0001", "\u0002"


def _marked(text: Column, pattern: str) -> Column:
    """The text cut at its matches: every second part is one."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}"))
    return F.split(marked, _MARK, -1)


def _ends(parts: Column) -> Column:
    """Where each part begins, and where the last one ends."""
    return F.aggregate(
        parts,
        F.array(F.lit(0).cast("bigint")),
        lambda ends, part: F.concat(ends, F.array(F.element_at(ends, -1) + F.length(part))),
    )


def _placed(parts: Column, ends: Column) -> Column:
    """(start, end, match) of all matches; code points, end exclusive."""
    numbers = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)))
    return F.transform(
        F.coalesce(numbers, F.array().cast("array<int>")),
        lambda i: F.struct(
            F.get(ends, i).alias("start"), F.get(ends, i + 1).alias("end"), F.get(parts, i).alias("match")
        ),
    )


def _plogp(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(0.0)


def entropy_extent(candidate: Column) -> Column:
    """(first, last): from the first window of high entropy to the end of the last one; -1 if none."""
    bits = F.when(candidate.rlike("^[0-9a-fA-F]+$"), HEX_BITS).otherwise(MIXED_BITS)
    codes = F.transform(
        F.filter(F.split(candidate, ""), lambda c: c != ""),
        lambda c: F.position(c, F.lit(_ALPHABET)),
    )
    leaving = F.slice(F.concat(F.array_repeat(F.lit(0), WINDOW), codes), F.lit(1), F.size(codes))
    moves = F.zip_with(codes, leaving, lambda a, b: F.struct(a.alias("comes"), b.alias("goes")))
    start = F.struct(
        F.array_repeat(F.lit(0), len(_ALPHABET) + 1).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(0).alias("at"),
        F.lit(-1).alias("first"),
        F.lit(-1).alias("last"),
        bits.alias("bits"),
    )

    def move(state: Column, step: Column) -> Column:
        comes, goes, at = step["comes"], step["goes"], state["at"] + 1
        old = F.get(state["counts"], goes)
        less = F.when(goes > 0, _plogp(old - 1) - _plogp(old)).otherwise(0.0)
        new = F.get(state["counts"], comes) - F.when(comes == goes, 1).otherwise(0)
        total = state["sum"] + less + _plogp(new + 1) - _plogp(new)
        counts = F.transform(
            state["counts"],
            lambda n, i: n + F.when(i == comes, 1).otherwise(0) - F.when((i == goes) & (goes > 0), 1).otherwise(0),
        )
        high = (at >= WINDOW) & (F.log2(F.lit(float(WINDOW))) - total / WINDOW >= state["bits"])
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            at.alias("at"),
            F.when(high & (state["first"] < 0), at - WINDOW).otherwise(state["first"]).alias("first"),
            F.when(high, at).otherwise(state["last"]).alias("last"),
            state["bits"].alias("bits"),
        )

    return F.aggregate(moves, start, move, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _spans(placed: Column, rank: int, extent: Callable[[Column], tuple[Column, Column]] | None = None) -> Column:
    def span(m: Column) -> Column:
        start, end = extent(m) if extent else (m["start"], m["end"])
        return F.struct(
            start.cast("bigint").alias("start"), F.lit(rank).alias("rank"), end.cast("bigint").alias("end"), F.lit(KINDS[rank]).alias("kind")
        )

    return F.transform(placed, span)


def _listed(spans: Column) -> Column:
    named = F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(named, ",")


def scan_secrets(documents: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every document.

    Null texts count as empty; a text without findings has empty ``spans`` and the hash of the
    empty string. Repeated rows repeat their result; other columns are ignored.
    """
    raw = F.coalesce("text", F.lit(""))
    text = F.when(F.instr(raw, _MARK) > 0, F.translate(raw, _MARK, _OTHER)).otherwise(raw)
    found = documents.select("doc_id", text.alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    found = found.select("doc_id", *[_marked(F.col("text"), p).alias(f"{k}_parts") for k, p in patterns.items()])
    found = found.select("*", *[_ends(F.col(f"{k}_parts")).alias(f"{k}_ends") for k in patterns])
    placed = [_placed(F.col(f"{k}_parts"), F.col(f"{k}_ends")).alias(k) for k in patterns]
    found = found.select("doc_id", *placed)
    value = lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= LEAST_VALUE
    unknown = lambda m: ~m["match"].rlike(ALLOW) & m["match"].rlike("[0-9]") & m["match"].rlike("[A-Za-z]")
    found = found.select(
        "doc_id",
        _spans(F.filter("assign", value), 0).alias("assign"),
        _spans(F.col("access"), 1).alias("access"),
        _spans(F.col("hex"), 2).alias("hex"),
        F.transform(
            F.filter("entropy", unknown),
            lambda m: F.struct(m["start"].alias("start"), entropy_extent(m["match"]).alias("extent")),
        ).alias("windows"),
    )
    high = F.filter("windows", lambda m: m["extent"]["first"] >= 0)
    where = lambda m: (m["start"] + m["extent"]["first"], m["start"] + m["extent"]["last"])
    base = F.concat("assign", "access", "hex")
    found = found.select("doc_id", "assign", "access", "hex", base.alias("base"), _spans(high, 3, where).alias("high"))
    covered = lambda s: F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    more = F.filter("high", lambda s: ~covered(s))
    return found.select(
        "doc_id",
        F.size("assign").cast("bigint").alias("n_assign"),
        F.size("access").cast("bigint").alias("n_access"),
        F.size("hex").cast("bigint").alias("n_hex"),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("base", more)).alias("spans"),
    )
