"""Spans of regular expressions in texts, by DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Running values are made by so many elements at a time, so that an array with very many costs no square of their number.
STEP = 128
#: Texts are cut from blocks of so many code points, so that a cut costs nothing for what stands before it.
BLOCK = 1024


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once. An expression that a lambda's body names is computed again for each element, also
    where the optimiser puts a column's expression there; the variable of a lambda is not."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scanned(values: Column, f: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Running values of an associative f over an array, each with its own element."""
    more = lambda acc, x: F.array_append(acc, f(F.element_at(acc, -1), x))
    part = lambda v, g: F.aggregate(F.slice(v, g * STEP + 1, F.lit(STEP)), F.array(zero), more)
    parts = lambda v: F.transform(F.sequence(F.lit(0), ((F.greatest(F.size(v), F.lit(1)) - 1) / STEP).cast("int")), lambda g: part(v, g))
    ahead = lambda p: F.aggregate(F.transform(p, lambda r: F.element_at(r, -1)), F.array(zero), more)
    whole = lambda p, o: F.flatten(F.transform(p, lambda r, i: F.transform(F.slice(r, F.lit(2), F.size(r) - 1), lambda x: f(x, F.get(o, i)))))
    return let(values, lambda v: let(parts(v), lambda p: let(ahead(p), lambda o: whole(p, o))))


def with_spans(df: DataFrame, text: str, patterns: dict[str, str], keep: dict[str, Callable[[Column], Column]], needs: dict[str, str] | None = None, prefix: str = "_s_", context: dict[str, int] | None = None) -> DataFrame:
    """Adds for each kind a column prefix + kind: array<struct<start: int, end: int, match: string>>, start first.

    Matches are the leftmost non-overlapping ones of a Java pattern (which never matches nothing); those that
    keep[kind](match) rejects are dropped afterwards, without another try. Offsets are code points, end exclusive. A null
    text has no spans. Positions come from the pieces between the matches: a piece and its match end where the sum of
    all lengths so far ends, so time grows with the text and the matches, not with their product. needs: characters of
    which every match of a kind holds one ("0" for any digit); texts without them aren't searched for it, which a look for
    single characters tells at a fraction of the cost. context: for these kinds the structs also hold `before` and `after`,
    at most so many code points from the neighbouring piece and match.
    """
    kinds, needs, context = list(patterns), needs or {}, context or {}
    has = {n: f"_h_{i}" for i, n in enumerate(dict.fromkeys(needs.values()))}
    look = lambda n: F.col(text).rlike("[0-9]") if n == "0" else reduce(lambda a, b: a | b, [F.col(text).contains(x) for x in n])
    df = df.withColumns({name: look(n) for n, name in has.items()})
    every = lambda k: F.regexp_extract_all(F.col(text), F.lit(patterns[k]), F.lit(0))
    found = df.withColumns({f"_m_{k}": F.when(F.col(has[needs[k]]), every(k)) if k in needs else every(k) for k in kinds}).drop(*has.values())

    def spans(k: str) -> Column:
        def one(m: Column, g: Column, e: Column) -> Column:
            def struct(x: Column, i: Column) -> Column:
                fields = [(F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), x.alias("match")]
                if k in context:
                    none = lambda c: F.coalesce(c, F.lit(""))
                    fields += [F.substring(F.concat(none(F.get(m, i - 1)), F.get(g, i)), -context[k], context[k]).alias("before"), F.substring(F.concat(F.get(g, i + 1), none(F.get(m, i + 1))), 1, context[k]).alias("after")]
                return F.struct(*fields)

            every = F.transform(m, struct)
            return F.filter(every, lambda s: keep[k](s["match"])) if k in keep else every

        lengths = lambda m, g: F.transform(m, lambda x, i: (F.length(x) + F.length(F.get(g, i))).cast("int"))
        ends = lambda m, g: scanned(lengths(m, g), lambda a, b: a + b, F.lit(0))
        return let(F.col(f"_m_{k}"), lambda m: let(F.split(F.col(text), patterns[k]), lambda g: let(ends(m, g), lambda e: one(m, g, e))))

    none = lambda k: F.array().cast("array<struct<start:int,end:int,match:string" + (",before:string,after:string" if k in context else "") + ">>")
    found = found.withColumns({f"{prefix}{k}": F.when(F.size(f"_m_{k}") > 0, spans(k)).otherwise(none(k)) for k in kinds})
    return found.drop(*[f"_m_{k}" for k in kinds])


def listed(spans: Column, kind: str, order: int, by_kind: bool) -> Column:
    """Spans as structs that sort as the digests want: by start, then kind; or by kind, then start."""
    a, b = (lambda s: F.lit(order), lambda s: s["start"]) if by_kind else (lambda s: s["start"], lambda s: F.lit(order))
    return F.transform(spans, lambda s: F.struct(a(s).alias("a"), b(s).alias("b"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["start"].alias("start")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def clusters(spans: Column, f: Callable[[Column, Column, Column, Column], Column], touching: bool) -> Column:
    """f(spans, first, next, end) of each run of spans that overlap (or touch), by their place in the array.

    spans: an array of structs by start, not empty; a run holds places first to next - 1 and reaches to end.
    """

    def runs(s: Column, reach: Column) -> Column:
        apart = lambda i: F.get(s, i)["start"] > F.get(reach, i - 1) if touching else F.get(s, i)["start"] >= F.get(reach, i - 1)
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | F.coalesce(apart(i), F.lit(True)))
        each = lambda h: F.transform(h, lambda a, k: let(F.coalesce(F.get(h, k + 1), F.size(s)), lambda b: f(s, a, b, F.get(reach, b - 1))))
        return let(heads, each)

    return let(spans, lambda s: let(scanned(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(-1)), lambda r: runs(s, r)))


def merged(spans: Column) -> Column:
    """Spans (by start, not empty) that overlap or touch as one: struct<start, end, kind>, of the first one's kind."""
    return clusters(spans, lambda s, a, b, end: F.struct(F.get(s, a)["start"].alias("start"), end.alias("end"), F.get(s, a)["kind"].alias("kind")), True)


def redacted(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with each of the spans (by start, not overlapping, at least one) replaced by mark(span)."""

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / BLOCK).cast("int")
        return F.substring(F.array_join(F.slice(blocks, first + 1, F.floor(b / BLOCK).cast("int") - first + 1), ""), a - first * BLOCK + 1, b - a)

    def whole(blocks: Column, s: Column) -> Column:
        before = F.transform(s, lambda x, i: let(F.coalesce(F.get(s, i - 1)["end"], F.lit(0)), lambda a: F.concat(cut(blocks, a, x["start"]), mark(x))))
        return F.concat(F.array_join(before, ""), cut(blocks, F.element_at(s, -1)["end"], F.length(text)))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: let(spans, lambda s: whole(blocks, s)))
