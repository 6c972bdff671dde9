"""Chat formatting in budgeted windows (built-in functions only).

A turn is written as `<|role|>text</s>`. Roles are percent-encoded. In texts a backslash is doubled,
and `<` and `[` get a backslash after them, so that no control string can occur inside a text
and every text can be read back.

A conversation's turns are cut into windows by the prefix sums of their tokens: turns that start in
the same stretch of `span` tokens share a window, and a turn longer than that has its own. A window
starts with the system turn and with the turns of the last HISTORY tokens before it; both are masked,
so that each assistant text is a target once. `span` is half of what system turn and history leave of
the budget, so that a window never exceeds it unless one turn alone does.

Tokens are counted by an upper bound that holds for every vocabulary whose tokens have a byte at
least: the bytes of the turn as it is written, marks and escapes included. Where real counts are known,
a column may give them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window at most, and of the history that it repeats.
BUDGET = 8192
HISTORY = 1024
#: Turn numbers per block: prefix sums run within blocks and over blocks, so that a conversation of
#: any length is dealt over many tasks.
BLOCK = 256


def escape(text: str) -> str:
    """SQL that escapes a text."""
    return rf"replace(replace(replace({text}, '\\', '\\\\'), '<', '<\\'), '[', '[\\')"


def unescape(text: str) -> str:
    return rf"replace(replace(replace({text}, '[\\', '['), '<\\', '<'), '\\\\', '\\')"


def tokens(text: str, role: str) -> Column:
    """Upper bound: the bytes of the turn as written."""
    return (F.octet_length(F.expr(escape(text))) + F.octet_length(F.url_encode(role)) + 8).cast("long")


def _placed(turns: DataFrame, budget: int, history: int, count: str | None) -> DataFrame:
    """Adds pos, start (tokens before), win and the conversation's system turn, null without one."""
    given = F.col(count).cast("long") if count else F.lit(None).cast("long")
    t = turns.select(
        F.col("conv_id").isNull().alias("z"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), given.alias("given"),
    )
    t = t.withColumn("n", F.coalesce("given", tokens("text", "role"))).drop("given")
    t = t.withColumn("block", F.floor(F.coalesce("turn", F.lit((1 << 63) - 1)) / BLOCK))
    order = [F.col("turn").asc_nulls_last(), "role", "text"]
    w = Window.partitionBy("z", "c", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("pos", F.row_number().over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    t = t.withColumn("start", F.sum("n").over(w) - F.col("n"))
    first = F.min(F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text", "n")).alias("first")
    b = t.groupBy("z", "c", "block").agg(F.sum("n").alias("bn"), F.count("*").alias("bk"), first)
    v = Window.partitionBy("z", "c").orderBy("block")
    before = v.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    b = b.select(
        "z", "c", "block", *[F.coalesce(F.sum(x).over(before), zero).alias(x) for x in ("bn", "bk")], F.first("first").over(v).alias("head")
    )
    t = t.join(b, ["z", "c", "block"])
    t = t.withColumn("pos", F.col("pos") + F.col("bk")).withColumn("start", F.col("start") + F.col("bn"))
    own = F.when(F.col("head.role") == "system", F.col("head.n")).otherwise(zero)
    t = t.withColumn("span", F.greatest(F.lit(1).cast("long"), F.floor((F.lit(budget - history) - own) / 2)))
    t = t.withColumn("long", (F.col("n") > F.col("span")).cast("long")).withColumn("longs", F.sum("long").over(w) - F.col("long"))
    b = t.groupBy("z", "c", "block").agg(F.sum("long").alias("bl"))
    t = t.join(b.select("z", "c", "block", F.coalesce(F.sum("bl").over(before), zero).alias("bl")), ["z", "c", "block"])
    t = t.withColumn("win", (2 * (F.col("longs") + F.col("bl")) + F.col("long")) * F.lit(1 << 31) + F.floor(F.col("start") / F.col("span")))
    return t.select("z", "c", "win", "pos", "start", "role", "text", F.when(F.col("head.role") == "system", F.col("head.text")).alias("system"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: str | None = None) -> DataFrame:
    """(conv_id, win, formatted, n_context, mask) from (conv_id, turn, role, text).

    win orders a conversation's windows; the first n_context turns of a window are repeated (system
    and history); mask lists (at, length), in code points, of the text to learn: the new assistant
    turns. A window holds at most `budget` tokens unless it has one new turn alone (or the system turn and
    the history leave nothing). count: a column with the turns' tokens, where null the bound is taken.

    Turns go by turn number, null last, then by role and text; repeated rows are turns of their own.
    Null texts and roles count as empty, null conv_ids as one conversation; further columns are
    ignored; an empty table gives an empty one."""
    t = _placed(turns, budget, history, count)
    is_system = "(pos = 0 and system is not null)"
    w = t.groupBy("z", "c", "win").agg(F.min("start").alias("s"), F.min("pos").alias("p0"), F.max("system").alias("system"))
    w = w.where("p0 > 0")
    near = w.select("z", "c", "win", "s", F.explode(F.expr(f"array(s div {history} - 1, s div {history})")).alias("h")) if history else w.limit(0).withColumn("h", F.lit(0).cast("long"))
    old = t.where(f"not {is_system}").select("z", "c", "pos", "start", "role", "text", F.expr(f"start div {max(1, history)}").alias("h"))
    old = near.join(old, ["z", "c", "h"]).where(f"start < s and start >= s - {history}")
    rows = t.select("z", "c", "win", F.lit(1).alias("new"), "pos", "role", "text")
    rows = rows.union(old.select("z", "c", "win", F.lit(0), "pos", "role", "text"))
    rows = rows.union(w.where("system is not null").select("z", "c", "win", F.lit(0), F.lit(-1), F.lit("system"), "system"))
    piece = F.struct("new", "pos", F.concat(F.lit("<|"), F.url_encode("role"), F.lit("|>")).alias("mark"), F.expr(escape("text")).alias("body"), (F.col("role") == "assistant").alias("talks"))
    out = rows.groupBy("z", "c", "win").agg(F.sort_array(F.collect_list(piece)).alias("x"))
    whole = "char_length(x.mark) + char_length(x.body) + 4"
    mask = f"""aggregate(x, named_struct('at', 0, 'out', cast(array() as array<struct<at:int,length:int>>)), (s, x) -> named_struct('at', s.at + {whole}, 'out',
 case when x.new = 1 and x.talks then concat(s.out, array(named_struct('at', s.at + char_length(x.mark), 'length', char_length(x.body)))) else s.out end)).out"""
    return out.select(
        F.when(~F.col("z"), F.col("c")).alias("conv_id"), "win",
        F.expr("array_join(transform(x, x -> concat(x.mark, x.body, '</s>')), '')").alias("formatted"),
        F.expr("size(filter(x, x -> x.new = 0))").alias("n_context"), F.expr(mask).alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, win, turns, learned) of windows(): the new turns as (role, text), and the texts under
    the mask, unescaped."""
    turn = rf"named_struct('role', url_decode(substring_index(substring(p, 3), '|>', 1)), 'text', {unescape(f'substring(p, instr(p, {chr(39)}|>{chr(39)}) + 2)')})"
    turns = f"transform(slice(split(formatted, '</s>'), n_context + 1, greatest(0, size(split(formatted, '</s>')) - 1 - n_context)), p -> {turn})"
    learned = f"transform(mask, m -> {unescape('substring(formatted, m.at + 1, m.length)')})"
    return formatted.select("conv_id", "win", F.char_length("formatted").cast("long").alias("chars"), F.expr(turns).alias("turns"), F.expr(learned).alias("learned"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. A hash of a whole conversation needs its text in one row."""
    said = "array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')"
    w = read_back(formatted).select("conv_id", F.struct("win", "chars", F.size("turns").alias("k"), F.expr(said).alias("said"), F.array_join("learned", "").alias("learned")).alias("w"))
    g = w.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    all_of = lambda f: f"array_join(transform(w, x -> x.{f}), '')"
    g = g.select("conv_id", "w", F.expr(all_of("said")).alias("said"), F.expr(all_of("learned")).alias("learned"))
    total = lambda f: F.expr(f"aggregate(w, 0L, (s, x) -> s + x.{f})")
    return g.select(
        "conv_id", total("k").alias("n_turns"), F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"),
    )
