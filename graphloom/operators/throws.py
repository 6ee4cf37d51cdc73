"""Exception propagation as a least fixpoint.

A function's body is cut into scopes: scope 0 is the body, each try block and each handler is a scope of its own. Facts:

* throws (usr, scope_id, type)             a throw expression
* rethrows (usr, scope_id)                 a bare rethrow in a handler
* calls (usr, scope_id, callee)            calls whose callee has a body that is seen (others are unknown and throw nothing)
* scopes (usr, scope_id, parent_scope_id, handler_order, catch_type, guards)
    a try block has catch_type null and guards null; a handler guards a try block's scope_id, is tried in handler_order,
    and catches catch_type and what derives from it, or all (catch_type '...')
* class_bases (derived, base)
* specs (usr, type)                        dynamic exception specifications of functions without a body

What leaves a try block passes its handlers in order: the first that fits takes it. A handler's own throws, calls and rethrows
count only if it caught something; a typed handler rethrows its catch type, ``...`` rethrows what it caught.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.sources import schema
from graphloom.sources.tables import forget, settled

ANY = "..."
MOST_ROUNDS = 100_000


def base_closure(class_bases: DataFrame) -> DataFrame:
    """derived, base for every class and all its direct and indirect bases, itself included."""
    own = class_bases.select(F.col("derived").alias("c")).unionByName(class_bases.select(F.col("base").alias("c"))).distinct()
    found = settled(own.select(F.col("c").alias("derived"), F.col("c").alias("base")))
    new = found
    direct = class_bases.select(F.col("derived").alias("base"), F.col("base").alias("up")).distinct()
    while True:
        step = new.join(direct, "base").select("derived", F.col("up").alias("base")).distinct()
        new = settled(step.join(found, ["derived", "base"], "left_anti"))
        if new.isEmpty():
            return found
        found = settled(found.unionByName(new))


def caught(types: DataFrame, closure: DataFrame) -> DataFrame:
    """types (type, catch_type): those that the catch takes, itself and what derives from it."""
    known = closure.select(F.col("derived").alias("type"), F.col("base").alias("catch_type"))
    return types.where((F.col("type") == F.col("catch_type")) | (F.col("catch_type") == ANY)).unionByName(types.where(F.col("type") != F.col("catch_type")).join(known, ["type", "catch_type"], "left_semi")).distinct()


def visible(edges: DataFrame) -> DataFrame:
    """The calls whose callee's body is seen in the TU (column callee_has_body): what a search within TUs follows."""
    return edges.where("callee_has_body")


def propagate(seeds: DataFrame, edges: DataFrame, closure: DataFrame, most: int | None = None) -> DataFrame:
    """usr, type that escape. seeds: usr, type. edges: usr, callee, catch_type (null: the call is not guarded). Semi-naive: each
    round joins only what is new. ``most`` bounds the calls between the throw and the function."""
    flat = settled(edges.select("usr", "callee", "catch_type").distinct())
    shield = closure.select(F.col("derived").alias("type"), F.col("base").alias("catch_type"), F.lit(True).alias("_held"))
    new = settled(seeds.select("usr", "type").distinct())
    parts = [new]
    for n in range(MOST_ROUNDS):
        if n == most:
            break
        step = new.withColumnRenamed("usr", "callee").join(flat, "callee")
        step = step.where(F.col("catch_type").isNull() | ((F.col("catch_type") != ANY) & (F.col("catch_type") != F.col("type")))).join(shield, ["type", "catch_type"], "left")
        step = step.where(F.col("_held").isNull()).select("usr", "type").distinct()
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        new = settled(step.join(found, ["usr", "type"], "left_anti"))
        if new.isEmpty():
            forget(new)
            return found
        parts.append(new)
        if len(parts) >= 16:
            merged = found.unionByName(new)
            parts = [settled(merged)]
    else:
        raise RuntimeError("no fixpoint")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def analyse(throws: DataFrame, calls: DataFrame, scopes: DataFrame, class_bases: DataFrame, rethrows: DataFrame | None = None, specs: DataFrame | None = None) -> DataFrame:
    """usr, type of all exceptions that escape from functions, by the scope rules above."""
    closure = base_closure(class_bases)
    handlers = scopes.where(F.col("guards").isNotNull())
    parent = scopes.select("usr", "scope_id", "parent_scope_id")
    is_handler = handlers.select("usr", "scope_id", F.col("guards"), "catch_type", "handler_order")
    again = rethrows.select("usr", "scope_id") if rethrows is not None else throws.select("usr", "scope_id").limit(0)

    # (usr, scope, type) raised in a scope; what a handler raises is held back until it caught something
    raised = settled(throws.select("usr", "scope_id", "type").distinct())
    out = specs.select("usr", "type").distinct() if specs is not None else None
    state = settled(raised.select("usr", "scope_id", "type"))
    while True:
        ways = is_handler.select("usr", F.col("guards").alias("scope_id"), F.col("scope_id").alias("handler"), "catch_type", "handler_order")
        held = state.join(ways, ["usr", "scope_id"])
        fits = caught(held.select("type", "catch_type").distinct(), closure)
        order = Window.partitionBy("usr", "scope_id", "type").orderBy("handler_order")
        taken = held.join(fits, ["type", "catch_type"], "left_semi").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        live = taken.select("usr", F.col("handler").alias("scope_id")).distinct()
        left = state.join(taken.select("usr", "scope_id", "type"), ["usr", "scope_id", "type"], "left_anti")
        # a handler's exceptions count if it is live; they go to the scope around its try block, like what a try block lets out
        dead = is_handler.select("usr", "scope_id").join(live, ["usr", "scope_id"], "left_anti")
        left = left.join(dead, ["usr", "scope_id"], "left_anti")
        up = left.join(parent, ["usr", "scope_id"]).select("usr", F.col("parent_scope_id").alias("scope_id"), "type")
        back = taken.join(again.withColumnRenamed("scope_id", "handler"), ["usr", "handler"], "left_semi")
        back = back.select("usr", F.col("handler").alias("scope_id"), F.when(F.col("catch_type") == ANY, F.col("type")).otherwise(F.col("catch_type")).alias("type"))
        escaped = left.where("scope_id = 0").select("usr", "type")
        if out is not None:
            escaped = escaped.unionByName(out)
        through = calls.join(escaped.select(F.col("usr").alias("callee"), "type"), "callee").select("usr", "scope_id", "type")
        more = settled(up.unionByName(back).unionByName(through).distinct().join(state, ["usr", "scope_id", "type"], "left_anti"))
        if more.isEmpty():
            return escaped.distinct()
        state = settled(state.unionByName(more))


def not_ignored(escaping: DataFrame, ignored=schema.IGNORED_EXCEPTIONS, ignore_bad_alloc: bool = True) -> DataFrame:
    """Without ignored types (by their short names) and, if asked, std::bad_alloc."""
    short = F.element_at(F.split("type", "::"), -1)
    out = escaping.where(~short.isin(*ignored)) if ignored else escaping
    return out.where(F.col("type") != schema.BAD_ALLOC) if ignore_bad_alloc else out


def summaries(functions: DataFrame, escaping: DataFrame, unknown: DataFrame) -> DataFrame:
    """usr, behaviour (Throwing, Unknown, NotThrowing), contains_unknown, types. functions, unknown: usr."""
    types = escaping.groupBy("usr").agg(F.sort_array(F.collect_set("type")).alias("types"))
    out = functions.select("usr").distinct().join(types, "usr", "left").join(unknown.select("usr", F.lit(True).alias("u")).distinct(), "usr", "left")
    size = F.size(F.coalesce("types", F.array().cast("array<string>")))
    behaviour = F.when(size > 0, "Throwing").when(F.col("u"), "Unknown").otherwise("NotThrowing")
    return out.select("usr", behaviour.alias("behaviour"), F.coalesce("u", F.lit(False)).alias("contains_unknown"), F.coalesce("types", F.array().cast("array<string>")).alias("types"))


def might_throw(functions: DataFrame, escaping: DataFrame) -> DataFrame:
    hit = not_ignored(escaping).select("usr").distinct().withColumn("might_throw", F.lit(True))
    return functions.select("usr").distinct().join(hit, "usr", "left").select("usr", F.coalesce("might_throw", F.lit(False)).alias("might_throw"))
