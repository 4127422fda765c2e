"""Secrets in texts, with weak candidates reported only next to their complements.

Strong kinds are reported wherever they match. A weak candidate alone says little: an account name, a
long mixed token or an address is no secret by itself. Each belongs to a role (identifier, secret or
endpoint), strong kinds have roles too, and a weak one is reported if at most ``scope`` code points lie between it
and a part of a complementary role in the same document. The parts are joined by intervals: places are
put into the bins of the scope's width that they touch, and a part meets those of all bins that its own
interval touches when widened by the scope. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergauge.llm.common import let, whole_text
from peergauge.session import write_shared

SCOPE = 200
MARK = "[SECRET]"


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


def _named(*names: str) -> str:
    return "(" + "|".join(_any_case(n) for n in names) + r")[\"']?\x20*[:=]\x20*[\"']?"


# Kind -> (pattern, quick test, part that must be long, its least length, role). In order of rank.
STRONG = {
    "assign": (
        _named("password", "passwd", "secret", "token", "api_?key") + "([A-Za-z0-9+/_.=-]+)",
        None,
        2,
        6,
        "secret",
    ),
    "access": ("AKIA[A-Z0-9]+", None, 0, 20, "identifier"),
    "hex": ("[0-9a-f]+", "[0-9a-f]{24}", 0, 24, "secret"),
}
_KEY = "[A-Za-z0-9+/]"
WEAK = {
    "ident": (
        _named("client_?id", "access_?key_?id", "user_?name", "user", "login", "account")
        + "([A-Za-z0-9_.@-]+)",
        None,
        2,
        3,
        "identifier",
    ),
    "key": (
        f"(?<!{_KEY})(?={_KEY}*[0-9])(?={_KEY}*[a-z])(?={_KEY}*[A-Z]){_KEY}{{20,}}",
        f"{_KEY}{{20}}",
        0,
        20,
        "secret",
    ),
    "endpoint": (
        "[A-Za-z][A-Za-z0-9+.-]*://[^\\x20\\x09-\\x0D\"'<>]+",
        "://",
        0,
        8,
        "endpoint",
    ),
}
KINDS = {**STRONG, **WEAK}
_RANK = {kind: rank for rank, kind in enumerate(KINDS)}
_SPAN = "struct<start:int,rank:int,end:int,kind:string>"
# Matches, or spans, that are worked off together: appending to an array copies it.
BLOCK = 256
# Spans that share a stretch of text: a place in a text is found by counting from its beginning.
STRETCH = 4096


def _blocks(array: Column, size: int = BLOCK) -> Column:
    """An array in pieces of ``size``, in order; none of an empty one."""
    last = F.floor((F.size(array) - 1) / size).cast("int")
    numbers = F.when(F.size(array) > 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))
    numbers = F.coalesce(numbers, F.array().cast("array<int>"))
    return F.transform(numbers, lambda b: F.slice(array, b * size + 1, F.lit(size)))


def _spans(text: Column, kind: str) -> Column:
    """Leftmost matches that do not overlap, as spans in code points; too short ones are dropped.

    The pieces between the matches give the places: splitting finds the same matches. A run of hex
    digits is matched only where it is long enough, which gives the same spans as dropping short
    runs, as a run is matched from its beginning.
    """
    pattern, test, part, least, _ = KINDS[kind]
    if kind == "hex":
        pattern = f"[0-9a-f]{{{least},}}"
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(part)).alias("part"),
    )
    sizes = F.transform(
        found,
        lambda x: F.struct(
            F.length(x["gap"]).alias("gap"),
            F.coalesce(F.length(x["match"]), F.lit(0)).alias("match"),
            F.coalesce(F.length(x["part"]) >= least, F.lit(False)).alias("long"),
        ),
    )
    none = F.array().cast(f"array<{_SPAN}>")

    def span(begin: Column, end: Column) -> Column:
        return F.struct(
            begin.alias("start"),
            F.lit(_RANK[kind]).alias("rank"),
            end.alias("end"),
            F.lit(kind).alias("kind"),
        )

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["match"]
        spans = F.when(x["long"], F.concat(state["spans"], F.array(span(begin, end))))
        return F.struct(end.alias("at"), F.coalesce(spans, state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    # Spans of each block from its own beginning, and how much text it covers.
    within = let(sizes, lambda x: F.transform(_blocks(x), lambda b: F.aggregate(b, start, step)))

    def begins(blocks: Column) -> Column:
        return F.aggregate(
            blocks,
            F.array(F.lit(0)),
            lambda so_far, b: F.concat(so_far, F.array(F.element_at(so_far, -1) + b["at"])),
        )

    def placed(blocks: Column, begin: Column) -> Column:
        def moved(block: Column, i: Column) -> Column:
            at = F.get(begin, i)
            return F.transform(block["spans"], lambda s: span(at + s["start"], at + s["end"]))

        return F.flatten(F.transform(blocks, moved))

    spans = let(within, lambda blocks: let(begins(blocks), lambda begin: placed(blocks, begin)))
    return F.when(text.rlike(test or pattern), spans).otherwise(none)


def _linked(located: DataFrame, scope: int) -> DataFrame:
    """(_row, _linked): the weak spans of each row that have a complement within the scope."""
    roles = F.create_map(*(F.lit(x) for kind in KINDS for x in (kind, KINDS[kind][4])))
    parts = located.select("_row", F.explode(F.concat("_strong", "_weak")).alias("part")).select(
        "_row", "part", roles[F.col("part.kind")].alias("role")
    )

    def bins(begin: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(begin / scope), F.floor(end / scope))).alias("bin")

    start, end = F.col("part.start"), F.col("part.end")
    weak = parts.where(F.col("part.kind").isin(*WEAK)).select(
        "_row", "part", "role", bins(start - scope, end + scope)
    )
    # Spans of one kind do not overlap: at most as many per kind as a bin is wide, and one more.
    places = (
        parts.select("_row", F.struct(start, end).alias("place"), "role", bins(start, end))
        .groupBy("_row", "bin", F.col("role").alias("other"))
        .agg(F.collect_set("place").alias("places"))
    )
    near = F.exists(
        "places", lambda p: F.greatest(p["start"], start) - F.least(p["end"], end) <= scope
    )
    return (
        weak.join(places, ["_row", "bin"])
        .where((F.col("role") != F.col("other")) & near)
        .groupBy("_row")
        .agg(F.collect_set("part").alias("_linked"))
    )


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The rows with ``strong`` and ``linked``: arrays of (start, rank, end, kind), in order.

    Starts and ends are code points of ``text``, the end exclusive. A null text is empty and has no
    spans. Rows alike are searched each for itself; an empty table gives no rows. ``docs`` is written
    to the shared folder with its spans, so select what is needed; columns named strong or linked
    are replaced. Spans may overlap if they are of different kinds.
    """
    text = whole_text()
    spans = {
        name: F.concat(*(_spans(text, kind) for kind in kinds))
        for name, kinds in (("_strong", STRONG), ("_weak", WEAK))
    }
    located = write_shared(
        docs.withColumns({**spans, "_row": F.monotonically_increasing_id()}), "secrets"
    )
    # Spans of one role have no complement; only rows with two roles are joined.
    every = F.concat("_strong", "_weak")

    def has(role: str) -> Column:
        kinds = [kind for kind in KINDS if KINDS[kind][4] == role]
        return F.exists(every, lambda s: s["kind"].isin(*kinds)).cast("int")

    roles = sum((has(role) for role in ("identifier", "secret", "endpoint")), F.lit(0))
    weak = (F.size("_weak") > 0) & (roles > 1)
    linked = _linked(located.where(weak).select("_row", "_strong", "_weak"), scope)
    none = F.array().cast(f"array<{_SPAN}>")
    own = located.where(weak).join(linked, "_row", "left")
    both = located.where(~weak).withColumn("_linked", none).unionByName(own)
    return both.withColumns(
        {
            "strong": F.sort_array("_strong"),
            "linked": F.sort_array(F.coalesce("_linked", none)),
        }
    ).drop("_row", "_strong", "_weak", "_linked")


def as_text(spans: Column) -> Column:
    """kind:start:end by start and kind, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def masked(text: Column, spans: Column, mark: str = MARK) -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``mark``.

    ``spans`` are in order. They are worked off in blocks, each with the stretch of text it covers.
    """

    def reached(blocks: Column, base: Column) -> Column:
        """How far the spans before each block, and before the end, reach."""
        return F.aggregate(
            F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"]))),
            F.array(base),
            lambda so_far, top: F.concat(
                so_far, F.array(F.greatest(F.element_at(so_far, -1), top))
            ),
        )

    def each(spans: Column, size: int, base: Column, parts) -> Column:
        """The parts that ``parts(block, from, to)`` makes of all blocks."""

        def joined(blocks: Column, reach: Column) -> Column:
            return F.flatten(
                F.transform(blocks, lambda b, i: parts(b, F.get(reach, i), F.get(reach, i + 1)))
            )

        return let(
            _blocks(spans, size), lambda b: let(reached(b, base), lambda r: joined(b, r))
        )

    def cut(whole: Column, offset: Column, base: Column, top: Column) -> Column:
        return F.substring(whole, base - offset + 1, top - base)

    def of_block(block: Column, base: Column, own: Column) -> Column:
        def step(so_far: Column, s: Column) -> Column:
            inside = (s["start"] < so_far["at"]) & (so_far["at"] > 0)
            gap = cut(own, base, so_far["at"], s["start"])
            out = F.when(inside, so_far["out"]).otherwise(
                F.concat(so_far["out"], F.array(gap, F.lit(mark)))
            )
            return F.struct(F.greatest(so_far["at"], s["end"]).alias("at"), out.alias("out"))

        start = F.struct(base.alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(block, start, step, lambda so_far: so_far["out"])

    def of_stretch(spans: Column, base: Column, top: Column) -> Column:
        def blocks(own: Column) -> Column:
            return each(
                spans,
                BLOCK,
                base,
                lambda b, begin, end: let(
                    cut(own, base, begin, end), lambda piece: of_block(b, begin, piece)
                ),
            )

        return let(cut(text, F.lit(0), base, top), blocks)

    parts = each(spans, STRETCH, F.lit(0), of_stretch)
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    rest = F.substring(text, last + 1, F.length(text))
    replaced = F.concat(F.array_join(parts, ""), rest)
    return F.when(F.size(spans) > 0, replaced).otherwise(text)
