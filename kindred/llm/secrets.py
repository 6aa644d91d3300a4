"""Operator 4, secret scans with multipart credential linking. DataFrame functions only.

Base kinds (assign, access, hex) are regular expressions whose matches must pass a length check. The
linker adds parts of credentials that are too weak alone: an identifier (an access key of another family, one of 12 to 19
characters, or an assigned user or client id), a secret (a mixed run of 32 or more base64 characters, 16 to 23 hex digits with a letter, an assigned
value of 3 to 5 characters) and an endpoint (a URL or a cloud host). A weak part is reported only when a complementary part,
or a base match that can stand for one, shares a scope with it in the same text.

Scopes come from structure and distance. Settings are `key = value` or `key: value` lines of up to 300 characters after the sign, and
innermost objects in braces with such a sign. A block is what lies between blank lines, section headings and braces; settings of one block
share a scope, however long it is. Otherwise parts share one that start within `scope` characters of each other, unless both are settings
and a heading or a brace stands between them: then they belong to different sections or objects. A prose part has only its distance.

The link is an interval join made of equi-joins: parts fall into bins of `scope` characters; each bin gets the
extremes of the partners in it and in its neighbours, which decide for every part of the bin whether a
partner is near. There are bins of all parts, of prose, and of each section's settings; a block is a bin of its own. No pairs are
made, so a text with many parts, or many rows of one text, costs in proportion. Only texts with a candidate are taken apart.

Cases: null text is empty and has no spans; spans are code points, end exclusive; empty results are empty
strings. Ties: parts that start together are all parts, in the order of their kinds. Very long texts are scanned whole. Rows
that repeat id and text share one result; null ids are ids of their own. Other columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import cut

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = ("assign", "access", "hex")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Weak parts: look-alikes of base matches that are too short among them.
IDENTIFIER = r"""AKIA[A-Z0-9]{8,15}(?![A-Z0-9])|\b(?:ASIA|AROA|AIDA|AGPA|ABIA)[A-Z0-9]{12,}|\b(?i:client_?id|access_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
# A match starts where a run does; the first digit, capital and small letter may stand anywhere in the run.
SECRET = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}={0,2}|(?<![0-9a-f])(?=[0-9]*[a-f])[0-9a-f]{16,23}(?![0-9a-f])"
SECRET += r"""|(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{3,5}(?![A-Za-z0-9+/_.=-])"""
ENDPOINT = r"""(?<![a-z0-9+.-])[a-z0-9+.-]+://[^\s"'<>]+|(?<![a-z0-9.-])[a-z0-9.-]+\.(?:amazonaws|azure|googleapis|cloudflarestorage)\.com\b"""
WEAK = ("identifier", "secret", "endpoint")
KINDS = BASE + WEAK
#: What each weak kind needs nearby.
NEEDS = {"identifier": ("secret", "assign", "hex"), "secret": ("identifier", "access", "endpoint"), "endpoint": ("secret", "access")}
SCOPE = 400
# Structure. A break is a blank line (soft), or a section's heading or a brace (hard); settings are objects or lines.
SOFT = r"\n[\x20\t\r]*+(?=\n)"
HARD = r"\n[\x20\t]*+\[[^\]\[{}\n]*+\][\x20\t\r]*+(?![^\n])|[{}]"
SETTING = r"""\{[^{}:=]*+[:=][^{}]*+\}|(?<![^\n])[\x20\t]*+(?:export\x20++|-\x20++)?["']?[A-Za-z_][A-Za-z0-9_.-]*+["']?[\x20\t]*+[:=](?!//)[^\n{}]{0,300}+(?![^\n])"""
MARKS = {"hard": len(KINDS), "soft": len(KINDS) + 1, "setting": len(KINDS) + 2}
_ALL, _PROSE, _BLOCK = -1, -2, -3  # pools of partners; a section's settings are the pool of its number

SPAN = "array<struct<start:int,kind:int,end:int>>"
_RUN = 256


def _running(lengths: Column) -> Column:
    """Sums of the elements before each element, in runs of _RUN so that long lists stay cheap."""
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(lengths) - 1) / _RUN).cast("int"))), lambda r: (r * _RUN + 1).cast("int"))
    sums = F.transform(starts, lambda s: F.aggregate(F.slice(lengths, s, _RUN), F.lit(0), lambda a, x: a + x))

    def scan(values: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    bases = scan(sums, F.lit(0))
    return F.flatten(F.zip_with(starts, bases, lambda s, b: scan(F.slice(lengths, s, _RUN), b)))


def spans(text: Column, pattern: str, kind: int, least: int, group: int = 0, guard: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end), of which `group` has at least `least` characters.

    Matches and the pieces between them alternate, so running sums of their lengths are the positions.
    guard: a cheap condition that holds wherever a match passes; only then is the text taken apart.
    """
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    pieces = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda a, b: F.array(F.length(a), F.length(b)))
    ends = F.transform(lengths, lambda x: F.element_at(x, 1) + F.element_at(x, 2))
    size = F.transform(F.regexp_extract_all(text, p, F.lit(group)) if group else found, lambda x: F.length(x))
    rows = F.arrays_zip(_running(ends).alias("before"), lengths.alias("parts"), size.alias("size"))
    kept = F.filter(rows, lambda r: r["size"] >= least)
    out = F.transform(
        kept,
        lambda r: F.struct(
            (r["before"] + F.element_at(r["parts"], 1)).cast("int").alias("start"),
            F.lit(kind).alias("kind"),
            (r["before"] + F.element_at(r["parts"], 1) + F.element_at(r["parts"], 2)).cast("int").alias("end"),
        ),
    )
    return F.when(F.lit(True) if guard is None else guard, out).otherwise(F.array().cast(SPAN))


def _joined(spans_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def base_spans(text: Column, low: Column) -> Column:
    """low: the text in lower case, for the guards."""
    # a run of hex digits or capitals that is too short fails whole, so these guards ask for the full length
    parts = [
        spans(text, ASSIGN, 0, 6, 2, _any(low, NAMES)),
        spans(text, ACCESS, 1, 20, 0, F.contains(text, F.lit("AKIA"))),
        spans(text, HEX, 2, 24, 0, F.regexp_like(text, F.lit("(?<![0-9a-f])[0-9a-f]{24}"))),
    ]
    return F.array_sort(F.concat(*parts))


def weak_spans(text: Column, low: Column) -> Column:
    guards = (
        _any(text, ("AKIA", "ASIA", "AROA", "AIDA", "AGPA", "ABIA")) | (_any(text, ("=", ":")) & _any(low, ("client", "access", "user", "login"))),
        F.regexp_like(text, F.lit("(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32}|(?<![0-9a-f])(?=[0-9]*[a-f])[0-9a-f]{16}")) | (_any(text, ("=", ":")) & _any(low, NAMES)),
        F.contains(text, F.lit("://")) | _any(text, (".amazonaws.com", ".azure.com", ".googleapis.com", ".cloudflarestorage.com")),
    )
    parts = [spans(text, p, 3 + k, 1, 0, g) for k, (p, g) in enumerate(zip((IDENTIFIER, SECRET, ENDPOINT), guards))]
    return F.array_sort(F.concat(*parts))


def _outside(weak: Column, base: Column) -> Column:
    """Weak spans that overlap no base span; both lists are short in any text but a dump of keys."""
    return F.filter(weak, lambda w: ~F.exists(base, lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"])))


def structure(text: Column, guard: Column) -> Column:
    """Breaks and settings of a text, as spans."""
    guard = guard & (F.contains(text, F.lit("\n")) | F.contains(text, F.lit("{")))
    patterns = {"hard": HARD, "soft": SOFT, "setting": SETTING}
    return F.concat(*[spans(text, p, MARKS[k], 1, 0, guard) for k, p in patterns.items()])


def placed(marked: DataFrame) -> DataFrame:
    """Parts (key, start, kind, end) out of parts and marks, with their section, block and whether they are settings."""
    hard, soft, setting = (F.col("kind") == MARKS[k] for k in ("hard", "soft", "setting"))
    first = F.when(hard | soft, 0).when(setting, 1).otherwise(2)  # of what starts together
    so_far = Window.partitionBy("key").orderBy("start", first, "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda c: F.sum(c.cast("int")).over(so_far)
    inside = F.coalesce(F.max(F.when(setting, F.col("end"))).over(so_far) > F.col("start"), F.lit(False))
    known = marked.select("key", "start", "kind", "end", count(hard).alias("section"), count(hard | soft).alias("block"), inside.alias("setting"))
    return known.where(F.col("kind") < len(KINDS))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts (key, start, kind, end, section, block, setting) with a partner in their scope."""
    binned = parts.withColumn("bin", F.floor(F.col("start") / scope))
    entry = lambda pool, at, d: F.struct(F.lit(pool).cast("long").alias("pool") if isinstance(pool, int) else pool.cast("long").alias("pool"), at.cast("long").alias("at"), F.lit(d).alias("d"))
    own = F.when(F.col("setting"), F.col("section")).otherwise(_PROSE)
    around = [entry(pool, F.col("bin") + d, d) for pool in (_ALL, own) for d in (-1, 0, 1)]
    block = entry(_BLOCK, F.col("block"), 0)
    offers = F.when(F.col("setting"), F.array(*around, block)).otherwise(F.array(*around))
    asks = F.when(F.col("setting"), F.array(entry(_PROSE, F.col("bin"), 0), entry(own, F.col("bin"), 0), block)).otherwise(F.array(entry(_ALL, F.col("bin"), 0)))

    near = binned.select("key", "kind", "start", F.explode(offers).alias("o"))
    code = {k: i for i, k in enumerate(KINDS)}
    extremes = []
    for k in KINDS:
        mine = F.col("kind") == code[k]
        extremes += [
            F.max(F.when(mine & (F.col("o.d") == 1), F.col("start"))).alias(f"{k}_left"),
            F.max(F.when(mine & (F.col("o.d") == 0), F.lit(True))).alias(f"{k}_here"),
            F.min(F.when(mine & (F.col("o.d") == -1), F.col("start"))).alias(f"{k}_right"),
        ]
    pools = near.groupBy(F.col("key").alias("k2"), "o.pool", "o.at").agg(*extremes)
    weak = binned.where(F.col("kind") >= len(BASE)).select("key", "start", "kind", "end", F.explode(asks).alias("o"))
    joined = weak.join(pools, (F.col("key") == F.col("k2")) & (F.col("o.pool") == F.col("pool")) & (F.col("o.at") == F.col("at")))

    def has(k: str) -> Column:
        here = F.coalesce(F.col(f"{k}_here"), F.lit(False))
        left = F.coalesce(F.col("start") - F.col(f"{k}_left") <= scope, F.lit(False))
        return here | left | F.coalesce(F.col(f"{k}_right") - F.col("start") <= scope, F.lit(False))

    ok = reduce(lambda a, b: a | b, [(F.col("kind") == code[k]) & reduce(lambda x, y: x | y, map(has, NEEDS[k])) for k in WEAK])
    return joined.where(ok).select("key", "start", "kind", "end").distinct()


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, base (spans of base matches) and added (linked weak parts), one row for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select("doc_id", text.alias("text"), F.lower(text).alias("low"))
    mark = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))
    scanned = whole.select("doc_id", base_spans(F.col("text"), F.col("low")).alias("base"), weak_spans(F.col("text"), F.col("low")).alias("weak"), mark.alias("key"), "text")
    rows = scanned.select("doc_id", "base", _outside(F.col("weak"), F.col("base")).alias("weak"), "key", "text")
    # one weak part needs another part: other texts have nothing to link
    rows = rows.withColumn("key", F.when((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1), F.col("key")))
    rows = rows.withColumn("marks", structure(F.col("text"), F.col("key").isNotNull())).drop("text")
    rows = cut(rows, "secret-spans")  # spans only; both branches below read it in place of the texts
    parts = rows.where(F.col("key").isNotNull()).select("key", F.explode(F.concat("weak", "base", "marks")).alias("s")).select("key", "s.*").distinct()
    added = linked(placed(parts), scope).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    nothing = F.array().cast(SPAN)
    linkable = rows.where(F.col("key").isNotNull()).join(added.withColumnRenamed("key", "key2"), F.col("key") == F.col("key2"), "left")
    # most rows have nothing to link: they aren't joined, or they would meet in one task
    alone = rows.where(F.col("key").isNull()).select("doc_id", "base", nothing.alias("added"))
    return linkable.select("doc_id", "base", F.coalesce("added", nothing).alias("added")).unionByName(alone)


def digest(found: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    base = _joined(F.col("base"))
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
