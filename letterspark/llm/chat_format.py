"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns are ordered by turn number (ties: role, then text). Running sums of turn tokens
choose spans of whole turns: a span's turns begin inside one half of the room that the
budget leaves beside the system turn and the history, so a span never exceeds the room; a
turn longer than half the room is a span of its own. Each span becomes a window: the
system turn (a first turn of that role), then up to ``REPEATED`` turns of limited size
from before the span, then the span. The loss mask covers the texts of assistant turns of
the span; what is repeated is masked out, so each assistant text counts once.

Template: ``<|turn|>`` role, line feed, text, ``<|end|>``. Control strings (this template's
and other common ones) in texts and roles are escaped reversibly: a backslash becomes
backslash 0, the first character of a control string backslash 1 or 2 (a line feed in a
role: backslash 3).

Tokens are estimated as a quarter of the characters, rounded up, plus four for the marks.

Defined results: null texts and roles are empty. Empty turns are turns. A conversation of
only a system turn is one window with that turn. Null ids form one conversation; a null
turn number comes first. Repeated rows are turns of their own. An empty table gives an
empty table; other columns are ignored. A turn beyond the budget is kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, REPEATED = 1024, 128, 2
OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Control strings by what follows their first character.
ANGLED = r"<(\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)"
SQUARE = r"\[(INST\]|/INST\])"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\0"))
    return F.regexp_replace(F.regexp_replace(text, ANGLED, r"\\1$1"), SQUARE, r"\\2$1")


def unescape(text: Column) -> Column:
    for mark, char in (("\\1", "<"), ("\\2", "["), ("\\3", "\n"), ("\\0", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def tokens(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("long") + 4


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, repeated: int = REPEATED) -> DataFrame:
    """``(conv_id, span, formatted, loss, n_context)``: a window each; loss: from and length in code points; n_context: turns that are repeated."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("pos", F.row_number().over(w) - 1)
    rows = rows.withColumn("is_system", (F.col("pos") == 0) & (F.col("role") == "system") & F.lead(F.lit(1)).over(w).isNotNull())
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\3"))
    rows = rows.withColumn("block", F.concat(F.lit(OPEN), role, F.lit("\n"), escape(F.col("text")), F.lit(CLOSE)))
    rows = rows.withColumn("tok", F.when(F.col("is_system"), 0).otherwise(tokens(F.col("text"))))
    rows = rows.withColumn("system_tok", F.first(F.when(F.col("is_system"), tokens(F.col("text"))).otherwise(0)).over(so_far))
    rows = rows.withColumn("system", F.first(F.when(F.col("is_system"), F.col("block"))).over(so_far))
    rows = rows.withColumn("half", F.greatest(F.lit(budget) - F.col("system_tok") - history, F.lit(budget // 4)).bitwiseAND(~1) / 2)
    rows = rows.withColumn("half", F.col("half").cast("long")).withColumn("big", F.col("tok") > F.col("half"))
    first = (F.col("pos") == 0) & ~F.col("is_system") | F.coalesce(F.lag("is_system").over(w), F.lit(False))
    rows = rows.withColumn("cut", first | (~F.col("is_system") & (F.col("big") | F.coalesce(F.lag("big").over(w), F.lit(False)))))
    rows = rows.withColumn("before", F.sum("tok").over(so_far) - F.col("tok"))
    rows = rows.withColumn("chunk", F.floor((F.col("before") - F.max(F.when(F.col("cut"), F.col("before"))).over(so_far)) / F.col("half")))
    rows = rows.withColumn("starts", F.col("cut") | F.coalesce(F.col("chunk") != F.lag("chunk").over(w), F.lit(False)))
    rows = rows.withColumn("span", F.sum(F.col("starts").cast("int")).over(so_far))

    entry = lambda span, kind, block: F.struct(span.alias("span"), F.col("pos").alias("pos"), F.lit(kind).alias("kind"), F.col("role").alias("role"), block.alias("block"))
    entries = [F.when(~F.col("is_system"), entry(F.col("span"), 1, F.col("block")))]
    system = F.struct(F.col("span").alias("span"), F.lit(-1).alias("pos"), F.when(F.col("span") > 1, 0).otherwise(1).alias("kind"), F.lit("system").alias("role"), F.col("system").alias("block"))
    entries.append(F.when(F.col("starts") & F.col("system").isNotNull(), system))
    for d in range(1, repeated + 1):
        near = F.lead("before", d).over(w) - F.col("before") <= history
        entries.append(F.when(~F.col("is_system") & F.lead("starts", d).over(w) & near, entry(F.lead("span", d).over(w), 0, F.col("block"))))
    found = rows.select("conv_id", F.array_compact(F.array(*entries)).alias("entries")).select("conv_id", F.explode("entries").alias("e"))
    windows = found.groupBy("conv_id", F.col("e.span").alias("span")).agg(F.sort_array(F.collect_list(F.struct("e.pos", "e.kind", "e.role", "e.block"))).alias("turns"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,n:int>>").alias("loss"))

    def add(acc: Column, t: Column) -> Column:
        lead = F.length(F.substring_index(t["block"], "\n", 1)) + 1
        size = F.length(t["block"])
        span = F.struct((acc["at"] + lead).alias("start"), (size - lead - len(CLOSE)).alias("n"))
        masked = (t["kind"] == 1) & (t["role"] == "assistant")
        return F.struct((acc["at"] + size).alias("at"), F.when(masked, F.array_append(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"))

    return windows.select(
        "conv_id",
        "span",
        F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("formatted"),
        F.aggregate("turns", start, add)["loss"].alias("loss"),
        F.size(F.filter("turns", lambda t: t["kind"] == 0)).alias("n_context"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per window: its own turns as text (role, line feed, text, line feed each), the text under the mask, and counts."""
    body = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")
    own = F.slice(body, F.col("n_context") + 1, F.greatest(F.size(body) - F.col("n_context"), F.lit(0)))
    role = lambda x: unescape(F.substring_index(F.substring(x, len(OPEN) + 1, 1 << 30), "\n", 1))
    text = lambda x: unescape(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2))
    turns = F.transform(own, lambda x: F.concat(role(x), F.lit("\n"), text(x), F.lit("\n")))
    loss = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["n"])))
    return windows.select(
        "conv_id",
        "span",
        F.size(own).cast("long").alias("n_turns"),
        F.array_join(turns, "").alias("turns"),
        F.array_join(loss, "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its windows (the contract of ``op3``).

    The contract asks for one digest over all turns, so here, unlike in ``format_windows``, a conversation's text meets in one row.
    """
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    kinds = conversations.select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast(kinds.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(kinds.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    parts = read_back(format_windows(kinds.unionByName(probe)))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("span", "turns", "loss"))).alias("p"), F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"))
    loss = F.array_join(F.col("p.loss"), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.col("p.turns"), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The same rows in DuckDB's SQL.
SQL = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (select *, row_number() over w - 1 as pos, lead(1) over w as more from c window w as (partition by conv_id order by turn nulls first, role, text)),
e as (select *, pos = 0 and role = 'system' and more is not null as is_system, (length(text) + 3) // 4 + 4 as t,
  {len(OPEN) + 1 + len(CLOSE)} + length(replace(regexp_replace(regexp_replace(replace(role, '\', '\0'), '{ANGLED}', '\\1\1', 'g'), '{SQUARE}', '\\2\1', 'g'), chr(10), '\3'))
    + length(regexp_replace(regexp_replace(replace(text, '\', '\0'), '{ANGLED}', '\\1\1', 'g'), '{SQUARE}', '\\2\1', 'g')) as size from o),
s as (select *, case when is_system then 0 else t end as tok, first_value(case when is_system then t else 0 end) over w as system_tok,
  first_value(case when is_system then size end) over w as system_size from e window w as (partition by conv_id order by pos)),
h as (select *, (greatest({BUDGET} - system_tok - {HISTORY}, {BUDGET // 4}) & ~1) // 2 as half from s),
b as (select *, tok > half as big from h),
k as (select *, (pos = 0 and not is_system) or coalesce(lag(is_system) over w, false) or (not is_system and (big or coalesce(lag(big) over w, false))) as cut,
  sum(tok) over w - tok as before from b window w as (partition by conv_id order by pos)),
n as (select *, (before - max(case when cut then before end) over w) // half as chunk from k window w as (partition by conv_id order by pos)),
q as (select *, cut or coalesce(chunk <> lag(chunk) over w, false) as starts from n window w as (partition by conv_id order by pos)),
r as (select *, {" + ".join(f"case when coalesce(lead(starts, {d}) over w, false) and lead(before, {d}) over w - before <= {HISTORY} then size else 0 end" for d in range(1, REPEATED + 1))} as again
  from q window w as (partition by conv_id order by pos))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(case when is_system then 0 else size + again end + case when starts then coalesce(system_size, 0) else 0 end)::bigint as formatted_chars
from r group by conv_id
"""
