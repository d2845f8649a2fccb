"""Secret scans in DataFrame expressions only: three fixed patterns, and a sliding-window entropy test.

Spark gives the strings a pattern matches but not where. Splitting the text by the same pattern gives the
strings between them, and running sums of both lengths are the offsets, in characters.

The entropy test looks at candidate strings, runs of token characters. A window moves along each one; the
counts of the characters in it change by one out and one in, and with them the running sum of c*log2(c), so a
step costs the same whatever the window's width. Digits, hexadecimal digits, letters of one case, of both, and
letters with digits have different entropies when random, so each candidate is held against the limit of its class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed_row

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes, the first that fits counts: pattern, and bits a character from which on a window is a secret.
#: Random windows of 20 have about 3.0 bits of digits, 3.5 of hexadecimal ones, 3.7 of letters of one case, 4.0 of
#: letters of both and 4.1 of letters and digits. Prose in one case comes to 3.6 in its longest words, so the limit
#: for such letters lies above what most random ones have; numbers of 20 digits are rather names than secrets.
CLASSES = {"digits": ("^[0-9]+$", 3.2), "hex": ("^([0-9a-f]+|[0-9A-F]+)$", 3.0), "letters": ("^([a-z]+|[A-Z]+|[A-Z][a-z]+)$", 4.0), "mixed letters": ("^[A-Za-z]+$", 3.9), "base64": ("", 3.6)}
#: Whole candidates that are no secrets: unique ids of a fixed form, lower- or upper-case words joined by separators,
#: paths of words, words joined by capitals, and keys of documentations, which end in a word that says so.
ALLOWED = (r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", r"^([a-z]+([_-][a-z]+)+|[A-Z]+([_-][A-Z]+)+)$", r"^/?([A-Za-z]+/)+[A-Za-z]*$", r"^[A-Z]?[a-z]+([A-Z][a-z]+)+$", r"EXAMPLE(KEY)?$")
#: Matches that are walked through together.
STRETCH = 64


def _let(value: Column, use) -> Column:
    """``use`` of ``value``, which is evaluated once; a lambda evaluates all else that it refers to for each element."""
    return F.transform(F.array(value), use)[0]


def _spans(text: Column, pattern: str, kind: str, gate: str) -> Column:
    """array<struct<start, end, kind, found>> of all matches; empty where ``gate``, the cheaper test, fails.

    Matches are walked through in stretches, and then the stretches, so that no long array grows by one at a time:
    the work for n matches is that of n * STRETCH and (n / STRETCH)^2 / 2 small steps.
    """
    none = F.array().cast("array<struct<start:int,end:int,kind:string,found:string>>")
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["found"].alias("found"))
        return F.when(x["found"].isNull(), done).otherwise(F.struct(F.concat(done["spans"], F.array(span)).alias("spans"), end.alias("at")))

    def stretches(all_: Column) -> Column:
        walk = lambda i: F.aggregate(F.slice(all_, i + 1, STRETCH), F.struct(none.alias("spans"), F.lit(0).alias("at")), step)
        return F.transform(F.sequence(F.lit(0), F.size(all_) - 1, F.lit(STRETCH)), walk)

    def joined(parts: Column) -> Column:
        before = F.aggregate(parts, F.array(F.lit(0)), lambda at, part: F.concat(at, F.array(F.element_at(at, -1) + part["at"])))
        moved = lambda x: F.transform(x["parts"]["spans"], lambda s: F.struct((s["start"] + x["before"]).alias("start"), (s["end"] + x["before"]).alias("end"), s["kind"].alias("kind"), s["found"].alias("found")))
        # The last sum has no stretch behind it.
        return F.flatten(F.transform(F.filter(F.arrays_zip(parts.alias("parts"), before.alias("before")), lambda x: x["parts"].isNotNull()), moved))

    return F.when(text.rlike(gate), _let(_let(zipped, stretches), joined)).otherwise(none)


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, bits a character, of any ``window`` characters in a row of ASCII ``text``.

    Counts by character are kept while the window slides; a text shorter than the window counts as one.
    """
    term = lambda c: F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)))).otherwise(F.lit(0.0))
    width = F.least(F.lit(window), F.length(text))
    codes = F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.ascii(x))
    # Each character with the one that leaves the window when it comes in; -1 while the window fills.
    moves = F.arrays_zip(codes.alias("new"), F.concat(F.array_repeat(F.lit(-1), width), codes).alias("old"))

    def put(counts: Column, code: Column, by: int) -> Column:
        return F.transform(counts, lambda c, i: F.when(i == code, c + by).otherwise(c))

    def slide(state: Column, x: Column) -> Column:
        grown = F.get(state["counts"], x["new"])
        s_in = state["s"] + term(grown + 1) - term(grown)
        shrunk = F.get(state["counts"], F.greatest(x["old"], F.lit(0))) + F.when(x["old"] == x["new"], 1).otherwise(0)
        s_out = F.when(x["old"] >= 0, s_in - term(shrunk) + term(shrunk - 1)).otherwise(s_in)
        counts = put(put(state["counts"], x["new"], 1), x["old"], -1)
        full = state["n"] + 1 >= state["width"]
        moved = F.struct(counts.alias("counts"), s_out.alias("s"), F.when(full, F.least(state["low"], s_out)).otherwise(state["low"]).alias("low"), (state["n"] + 1).alias("n"), state["width"].alias("width"))
        return F.when(x["new"].isNull(), state).otherwise(moved)

    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("s"), F.lit(1e9).alias("low"), F.lit(0).alias("n"), width.alias("width"))
    low = F.aggregate(moves, start, slide)["low"]
    return F.when(F.length(text) > 0, F.log2(width) - low / width).otherwise(F.lit(0.0))


Classes = dict[str, tuple[str, float]]


def _suspect(found: Column, window: int, classes: Classes, allowed: tuple[str, ...]) -> Column:
    """Some window reaches the limit of the candidate's class, and no pattern of the allow-list fits."""
    ok, limit = F.lit(False), F.lit(float("inf"))
    for pattern in allowed:
        ok = ok | found.rlike(pattern)
    for pattern, bits in reversed(classes.values()):
        limit = F.when(found.rlike(pattern), bits).otherwise(limit)
    return ~ok & (window_entropy(found, window) >= limit)


def find_secrets(docs: DataFrame, window: int = WINDOW, classes: Classes = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """row (the input row, all columns) and secrets: array<struct<start, end, kind, found>>, by start, then kind
    as assign, access, hex, entropy; offsets in characters, end exclusive.

    Base kinds are all matches, leftmost and not overlapping within a kind, that are long enough. Entropy
    spans are candidates in which some window is random enough for their class and which no allow-list
    pattern fits; a candidate inside a base span is not reported again. Null and empty texts have no secrets;
    repeated rows are scanned each, texts whole, however long; an empty table gives an empty one. Input columns may
    have any names: they stay inside ``row``.
    """
    packed = docs.select(packed_row(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    words = _spans(text, ASSIGN, "assign", r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")
    assign = F.filter(words, lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= LEAST["assign"])
    # Runs of these classes are maximal, so the length can stand in the pattern.
    access = _spans(text, f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", "access", "AKIA[A-Z0-9]{14}")
    hexes = _spans(text, f"[0-9a-f]{{{LEAST['hex']},}}", "hex", f"[0-9a-f]{{{LEAST['hex']}}}")
    base = packed.withColumn("_base", F.concat(assign, access, hexes))
    likely = F.filter(_spans(text, CANDIDATE, "entropy", CANDIDATE), lambda s: _suspect(s["found"], window, classes, allowed))
    fresh = F.filter(F.col("_likely"), lambda s: ~F.exists("_base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    rank = lambda k: F.array_position(F.array(*map(F.lit, ("assign", "access", "hex", "entropy"))), k)
    keyed = F.transform(F.concat("_base", fresh), lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["found"].alias("found")))
    plain = F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["found"].alias("found")))
    return base.withColumn("_likely", likely).select("row", plain.alias("secrets"))


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy. Repeated rows are reported each; null and
    empty texts have no spans, and the digest of nothing; kinds that begin together stand in the order of the columns."""
    seen = find_secrets(docs.select("doc_id", "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    return seen.select("row.doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"), of("entropy").alias("n_entropy"))
