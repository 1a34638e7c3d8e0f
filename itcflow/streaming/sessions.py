"""Chat confirmation sessions as a declared transition table.

A message is first reduced to a symbol with column expressions (photo, confirm,
cancel, edit, which, other). What a session does is the table ``MOVES``:
(state, symbol) -> (next state, action).

A sender's messages are numbered over many tasks and cut into blocks of
``BLOCK``. A block is a function: from each of the few positions a session can
be in (idle, open, asked for one of the fields) to the position after the block
and the fields it has set. Functions compose to functions of the same size, so
where each block starts is a scan: blocks of blocks are composed level by
level, ``BLOCK`` at a time, and the starts are handed down again. Then every
block is folded from its start on its own. No row grows with a sender, however
many messages there are between two photos; senders with a single block skip
the scan.

States: ``idle`` (nothing pending), ``open`` (an invoice waits for a reply),
``asked`` (the next message is the value of a field). A pending invoice waits
for as long as it takes; nothing lapses.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import keywords as K
from ..functions.text import clean_edit_amount, norm_phone
from ..operators.skew import prefix_sum
from ..session import shared_dir

MOVES = {
    ("idle", "photo"): ("open", "pending"), ("open", "photo"): ("open", "pending"), ("asked", "photo"): ("open", "pending"),
    ("open", "confirm"): ("idle", "saved"), ("open", "cancel"): ("idle", "cancelled"),
    ("open", "edit"): ("asked", "ask_value"), ("open", "which"): ("open", "ask_field"), ("open", "other"): ("open", "prompt"),
}
#: Fields whose new value has to be an amount.
AMOUNTS = ["taxable_amount", "cgst", "sgst", "igst", "total_amount"]

_FIELDS = "map<string,string>"
STATE = f"struct<state:string,field:string,fields:{_FIELDS}>"
_OUT = f"array<struct<event_id:bigint,ts:timestamp,action:string,detail:string,fields:{_FIELDS}>>"
_FOLD = f"struct<state:string,field:string,fields:{_FIELDS},out:{_OUT}>"
#: Where a block leads from one position: ``reset`` if a photo came in it; ``fields`` are
#: what it has set since then, or on top of what there was.
_LEADS = f"struct<state:string,field:string,reset:boolean,fields:{_FIELDS}>"
#: Messages of a block, blocks of a block of blocks: what one row holds.
BLOCK = 64


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage, pins the rows."""
    path = shared_dir(df.sparkSession, f"itcflow-sessions/{uuid.uuid4().hex}/{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def symbols(msgs: DataFrame) -> DataFrame:
    """``sender, event_id, ts, symbol, field, value, amount, intent, fields``.
    ``fields`` is what the photo's extraction read; without such a column the
    invoice number stands for it."""
    low = F.lower(F.trim(F.coalesce("body", F.lit(""))))
    alias = F.create_map(*[F.lit(x) for kv in fixed.FIELD_ALIASES for x in kv])
    field = F.when(low.startswith("edit "), F.element_at(alias, F.trim(F.replace(low, F.lit("edit "), F.lit("")))))
    symbol = (F.when(F.col("has_photo"), "photo").when(K.any_of(low, fixed.CONFIRM_WORDS), "confirm")
               .when(K.any_of(low, fixed.CANCEL_WORDS), "cancel").when(field.isNotNull(), "edit")
               .when(low.startswith("edit "), "which").otherwise("other"))
    read = F.col("fields") if "fields" in msgs.columns else F.create_map(
        F.lit("invoice_no"), F.concat(F.lit("EV/"), F.col("event_id").cast("string")))
    value = F.trim(F.coalesce("body", F.lit("")))
    return msgs.select(norm_phone(F.col("sender")).alias("sender"), "event_id", "ts", symbol.alias("symbol"),
                       field.alias("field"), value.alias("value"), clean_edit_amount(value).alias("amount"),
                       K.first_group(low, fixed.INTENTS, "fallback").alias("intent"),
                       F.when(F.col("has_photo"), read).cast(_FIELDS).alias("fields"))


def _move(state: Column, field: Column, m: Column) -> tuple[Column, Column, Column, Column]:
    """Next state, action, whether a value was refused, and the value an answer gives."""
    table = F.create_map(*[x for (s, y), (n, a) in MOVES.items()
                           for x in (F.lit(f"{s} {y}"), F.struct(F.lit(n).alias("next"), F.lit(a).alias("action")))])
    known = F.element_at(table, F.concat_ws(" ", state, m["symbol"]))
    answer = (state == "asked") & (m["symbol"] != "photo")   # the value that was asked for
    number = field.isin(AMOUNTS)
    refused = answer & number & m["amount"].isNull()
    action = F.when(refused, "refused").when(answer, "edited").when(known.isNotNull(), known["action"]).otherwise("intent")
    following = F.when(answer, "open").when(known.isNotNull(), known["next"]).otherwise(state)
    return following, action, answer & ~refused, F.when(number, m["amount"].cast("string")).otherwise(m["value"])


def _set(fields: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(fields, lambda k, v: k != key), F.create_map(key, value))


def _step(acc: Column, m: Column) -> Column:
    """A message in a session whose position is known."""
    state, action, edited, told = _move(acc["state"], acc["field"], m)
    fields = F.when(m["symbol"] == "photo", m["fields"]).when(edited, _set(acc["fields"], acc["field"], told)).otherwise(acc["fields"])
    detail = (F.when(action == "intent", m["intent"]).when(action.isin("edited", "refused"), acc["field"])
               .when(action == "ask_value", m["field"]).when(action.isin("pending", "saved", "cancelled"), fields["invoice_no"])
               .otherwise(""))
    row = F.struct(m["event_id"].alias("event_id"), m["ts"].alias("ts"), action.alias("action"), detail.alias("detail"),
                   F.when(action.isin("saved", "cancelled", "edited"), fields).alias("fields"))
    return F.struct(state.alias("state"), F.when(action == "ask_value", m["field"]).alias("field"),
                    F.when(state != "idle", fields).alias("fields"),
                    F.concat(acc["out"], F.array(row)).alias("out")).cast(_FOLD)


def _position(x: Column) -> Column:
    return F.concat_ws(" ", x["state"], x["field"])


def _nowhere() -> Column:
    """The function that leads from every position to itself."""
    none = F.create_map().cast(_FIELDS)
    at = [("idle", None), ("open", None), *[("asked", f) for f in sorted({f for _, f in fixed.FIELD_ALIASES})]]
    return F.create_map(*[x for s, f in at for x in (
        F.lit(" ".join(filter(None, (s, f)))),
        F.struct(F.lit(s).alias("state"), F.lit(f).cast("string").alias("field"), F.lit(False).alias("reset"), none.alias("fields")).cast(_LEADS))])


def _lead(x: Column, m: Column) -> Column:
    """One message more at the end of a block, for one position it may start from."""
    state, action, edited, told = _move(x["state"], x["field"], m)
    photo = m["symbol"] == "photo"
    fields = F.when(photo, m["fields"]).when(edited, _set(x["fields"], x["field"], told)).otherwise(x["fields"])
    return F.struct(state.alias("state"), F.when(action == "ask_value", m["field"]).alias("field"),
                    (x["reset"] | photo).alias("reset"), fields.alias("fields")).cast(_LEADS)


def _over(below: Column, top: Column) -> Column:
    """Fields ``below`` with those of ``top`` set on them."""
    return F.map_concat(F.map_filter(below, lambda k, v: ~F.map_contains_key(top, k)), top)


def _then(x: Column, f: Column) -> Column:
    """Where ``x`` leads with the function ``f`` after it."""
    y = F.element_at(f, _position(x))
    return F.struct(y["state"].alias("state"), y["field"].alias("field"), (x["reset"] | y["reset"]).alias("reset"),
                    F.when(y["reset"], y["fields"]).otherwise(_over(x["fields"], y["fields"])).alias("fields")).cast(_LEADS)


def _after(was: Column, f: Column) -> Column:
    """The position after a block that starts at ``was``."""
    y = F.element_at(f, _position(was))
    had = F.coalesce(was["fields"], F.create_map().cast(_FIELDS))
    return F.struct(y["state"].alias("state"), y["field"].alias("field"),
                    F.when(y["state"] != "idle", F.when(y["reset"], y["fields"]).otherwise(_over(had, y["fields"]))).alias("fields")).cast(STATE)


def _in_order(col: str, *by: str) -> Column:
    """Sorted by some fields only: maps in a row can't be compared."""
    def cmp(x, y):
        out = F.lit(0)
        for c in reversed(by):
            first = x[c].isNull() & y[c].isNotNull()
            last = x[c].isNotNull() & y[c].isNull()
            out = F.when(first | (x[c] < y[c]), -1).when(last | (x[c] > y[c]), 1).otherwise(out)
        return out
    return F.array_sort(F.collect_list(col), cmp)


def _starts(blocks: DataFrame, first: DataFrame) -> DataFrame:
    """``sender, block, start``: where each block starts. ``blocks``: sender, block
    (from 0, without gaps) and its function ``f``; ``first``: sender, start."""
    levels = [materialize(blocks, "block-functions")]
    while levels[-1].agg(F.max("block")).first()[0] > 0:
        up = levels[-1].groupBy("sender", F.floor(F.col("block") / BLOCK).alias("block")).agg(
            _in_order(F.struct("block", "f"), "block").alias("parts"))
        levels.append(materialize(up.withColumn("f", F.aggregate(
            "parts", _nowhere(), lambda acc, p: F.transform_values(acc, lambda k, x: _then(x, p["f"])))), "block-functions"))
    starts = first.select("sender", F.lit(0).cast("long").alias("block"), "start")
    for level in reversed(levels[1:]):
        # inside a block of blocks: the start, then the start moved on by each part but the last
        at = F.struct(F.col("start").alias("at"), F.array().cast(f"array<{STATE}>").alias("out"))
        walk = F.aggregate("parts", at, lambda acc, p: F.struct(_after(acc["at"], p["f"]).alias("at"),
                                                               F.concat(acc["out"], F.array(acc["at"])).alias("out")))
        starts = (level.join(starts, ["sender", "block"]).select("sender", F.explode(F.arrays_zip("parts.block", walk["out"].alias("start"))).alias("p"))
                       .select("sender", F.col("p.block").alias("block"), F.col("p.start").alias("start")))
    return starts


def fold(msgs: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """``sender, block, was, last, done``: one row per block of a sender's messages in
    order of (ts, event_id), null first, with the positions it starts and ends in
    and its steps. ``carried`` (``sender, state`` of type ``STATE``) is where senders stood
    before; without it they start idle. Messages without a sender are one sender's."""
    m = symbols(msgs).withColumn("sender", F.coalesce("sender", F.lit("")))
    order = ["ts", "event_id"]
    step = F.struct("ts", "event_id", "symbol", "field", "value", "amount", "intent", "fields")
    nth = prefix_sum(m.withColumn("again", F.monotonically_increasing_id()), ["sender"], [*order, "again"], F.lit(1).cast("long"), "nth")
    blocks = materialize(nth.groupBy("sender", F.floor((F.col("nth") - 1) / BLOCK).alias("block"))
                            .agg(_in_order(step, *order).alias("steps")), "blocks")
    idle = F.struct(F.lit("idle").alias("state"), F.lit(None).cast("string").alias("field"),
                    F.lit(None).cast(_FIELDS).alias("fields")).cast(STATE)
    first = blocks.where("block = 0").select("sender")
    if carried is None:
        first = first.withColumn("start", idle)
    else:
        first = first.join(carried.withColumnRenamed("state", "_was"), "sender", "left").select(
            "sender", F.coalesce("_was", idle).alias("start"))
    several = blocks.where("block > 0").select("sender").distinct()
    long = blocks.join(several, "sender", "left_semi").withColumn(
        "f", F.aggregate("steps", _nowhere(), lambda acc, x: F.transform_values(acc, lambda k, y: _lead(y, x))))
    if several.isEmpty():
        starts = first.withColumn("block", F.lit(0).cast("long"))
    else:
        starts = _starts(long.select("sender", "block", "f"), first).unionByName(
            first.join(several, "sender", "left_anti").withColumn("block", F.lit(0).cast("long")))
    start = F.struct(F.col("start.state").alias("state"), F.col("start.field").alias("field"),
                     F.col("start.fields").alias("fields"), F.array().cast(_OUT).alias("out")).cast(_FOLD)
    folded = blocks.join(starts, ["sender", "block"]).withColumn("f", F.aggregate("steps", start, _step))
    end = F.struct(F.col("f.state").alias("state"), F.col("f.field").alias("field"), F.col("f.fields").alias("fields")).cast(STATE)
    return folded.select("sender", "block", F.col("start").alias("was"), end.alias("last"), F.col("f.out").alias("done"))


def steps(folded: DataFrame) -> DataFrame:
    """``sender, event_id, ts, action, detail, fields``: what each message did.
    ``fields`` is the invoice with its edits where one is saved, cancelled or edited."""
    return folded.select("sender", F.inline("done"))


def ends(folded: DataFrame) -> DataFrame:
    """``sender, was, state``: where each sender stood before its first block and stands after its last."""
    return folded.groupBy("sender").agg(F.min_by("was", "block").alias("was"), F.max_by("last", "block").alias("state"))


def confirm_sessions_batch(msgs: DataFrame) -> DataFrame:
    """The steps of a finite table of messages."""
    return steps(fold(msgs))


def saved_invoices(done: DataFrame) -> DataFrame:
    """The confirmed invoices as the parsed rows of F19, edits included."""
    f = F.col("fields")
    text = {c: f[c].alias(c) for c in ("seller_gstin", "invoice_no", "invoice_date")}
    return done.filter(F.col("action") == "saved").select(
        "sender", "event_id", "ts", *text.values(), *[f[c].try_cast("double").alias(c) for c in AMOUNTS])
