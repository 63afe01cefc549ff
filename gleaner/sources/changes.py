"""Logs of changes: several creates, partial updates and deletes of one key, applied in their order."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.sources.scratch import dropped, stored

#: Changes that one task applies one after the other, about.
PART = 1 << 18
_OUT = "place long, step long, outcome string, state string, fields array<string>"
#: Of one key: changes of equal order by what they do, so that no layout of the log's files decides; place only parts those that are alike.
_SORT = ["__key", "__order", "op", "given", "place"]


def _applied(valid: Callable[[dict], bool] | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Fold over the changes of one part; a row comes in with the state that its key has before the part."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(_SORT, kind="stable", na_position="first")
        key, state, out = None, None, []
        for k, op, given, before in zip(rows["__key"], rows["op"], rows["given"], rows["before"], strict=True):
            if k != key:
                key, state = k, json.loads(before) if isinstance(before, str) else None
            new = {name: value for name, value in json.loads(given).items() if value is not None}
            after = None if op == "delete" else {**(state or {}), **new}
            if op == "create" and state is not None:
                outcome = "duplicate"
            elif op != "create" and state is None:
                outcome = "not_found"
            elif after is not None and valid is not None and not valid(after):
                outcome = "invalid"
            elif after == state:
                outcome = "no_op"
            else:
                outcome = "ok"
            changed = sorted(c for c in new if (state or {}).get(c) != new[c]) if outcome == "ok" and after is not None else []
            state = after if outcome == "ok" else state
            out.append((outcome, None if state is None else json.dumps(state), changed))
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pd.DataFrame({"place": rows["place"], "step": rows["part"].astype("int64") * (1 << 32) + range(len(rows)), "outcome": columns[0], "state": columns[1], "fields": columns[2]})

    return run


def apply_log(table: DataFrame, log: DataFrame, key: str, order: str, unique: tuple[str, ...] = (), valid: Callable[[dict], bool] | None = None, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(the table after the log, the log with `outcome` and `fields`): changes of a key take effect in the order of a column.

    log has the key, the order column, `op` (create, update or delete) and any columns of the table, where null keeps what
    is there.  Changes of a key with equal order go by op, then by the JSON of what they set, so the log's files may be laid
    out in any way.  outcome is ok, no_op (an update that changes nothing), not_found, duplicate (a create of what is there) or
    invalid (valid(row as a dict) is false for the row after it); what is not ok changes nothing.  fields names what an ok
    change set.  A key whose last row would repeat the unique columns of another row, as that was before or is after the
    log, keeps its row of before, and its changes are all conflict; of several keys that end so, the one that got
    there first prevails.

    Changes are sorted into parts of about `part` rows, which are folded row by row; a key that fills several parts is
    taken up part after part, its state handed on as a table.  Changes with a null key are not_found.
    """
    fields = [c for c in table.columns if c != key]
    given = [c for c in fields if c in log.columns]
    as_json = lambda names: F.to_json(F.struct(*names), {"ignoreNullFields": "true"})
    numbered = stored(log.withColumn("place", F.monotonically_increasing_id()), "log")
    state = table.select(F.col(key).alias("__key"), as_json(fields).alias("before"))
    told = numbered.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(order).alias("__order"), "place", "op", as_json(given).alias("given"))
    told = told.join(state, "__key", "left")
    parts = max(1, -(-numbered.count() // part))
    rows = stored(told.repartitionByRange(parts, *_SORT).withColumn("part", F.spark_partition_id()), "changes")
    spans = stored(rows.groupBy("__key").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first < last"), "spans")  # fewer than parts
    rows = rows.join(F.broadcast(spans.select("__key", "first")), "__key", "left").withColumn("turn", F.coalesce(F.col("part") - F.col("first"), F.lit(0)))
    columns, done = ["__key", "__order", "place", "op", "given", "before", "part"], []
    for turn in range(1 + (spans.agg(F.max(F.col("last") - F.col("first"))).first()[0] or 0)):
        now = rows.where(F.col("turn") == turn)
        if done:
            latest = reduce(DataFrame.unionByName, done).join(rows.select("place", "__key"), "place").join(F.broadcast(spans.select("__key")), "__key", "left_semi")
            handed = latest.groupBy("__key").agg(F.max(F.struct("step", "state"))["state"].alias("handed"))
            now = now.drop("before").join(F.broadcast(handed), "__key", "left").withColumnRenamed("handed", "before")  # fewer rows than parts
        done.append(stored(now.select(*columns).groupBy("part").applyInPandas(_applied(valid), _OUT), "applied"))
    applied = reduce(DataFrame.unionByName, done)
    last = applied.join(rows.select("place", "__key", "__order"), "place").groupBy("__key").agg(F.max(F.struct("step", "state")).alias("x"), F.max(F.when(F.col("outcome") == "ok", F.struct("__order"))).alias("since"))
    kind = table.select(*fields).schema
    ends = stored(last.select("__key", "since", F.from_json("x.state", kind).alias("row")), "ends")
    refused = _conflicts(table, ends, key, unique) if unique else ends.limit(0).select("__key")
    refused = stored(refused, "refused")
    changed = ends.join(refused, "__key", "left_anti")
    out = table.join(changed.select(F.col("__key").alias(key)), key, "left_anti").unionByName(changed.where("row is not null").select(F.col("__key").alias(key), "row.*"))
    met = numbered.join(applied.select("place", "outcome", "fields"), "place", "left").join(refused.select(F.col("__key").alias(key), F.lit(True).alias("__no")), key, "left")
    outcome = F.when(F.col("__no"), "conflict").otherwise(F.coalesce("outcome", F.lit("not_found")))
    dropped(spans)
    return out.select(*table.columns), met.select(*log.columns, outcome.alias("outcome"), F.when(F.col("__no"), F.array().cast("array<string>")).otherwise(F.coalesce("fields", F.array().cast("array<string>"))).alias("fields"))


def _conflicts(table: DataFrame, ends: DataFrame, key: str, unique: tuple[str, ...]) -> DataFrame:
    """(__key) whose last row repeats the unique columns of another row of before, or of one that got there earlier."""
    mark = lambda prefix: F.to_json(F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in unique]))
    before = table.select(F.col(key).alias("__key"), mark("").alias("mark"))
    after = ends.where("row is not null and since is not null").select("__key", "since", mark("row.").alias("mark"))
    after = after.join(before, ["__key", "mark"], "left_anti")  # what stays as it was conflicts with nothing new
    held = after.join(before.select("mark").distinct(), "mark", "left_semi").select("__key")
    first = after.groupBy("mark").agg(F.min(F.struct("since", "__key"))["__key"].alias("owner"))
    return held.unionByName(after.join(first, "mark").where("__key <> owner").select("__key")).distinct()


def change_audit(applied: DataFrame, entity: str, key: str) -> DataFrame:
    """(action, entity, entity_id, payload): a row for each change that took effect, with the fields that it set."""
    done = applied.where("outcome = 'ok'")
    return done.select(F.concat(F.lit(f"{entity}."), "op").alias("action"), F.lit(entity).alias("entity"), F.col(key).cast("string").alias("entity_id"), F.to_json(F.struct("fields")).alias("payload"))
