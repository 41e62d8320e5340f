"""Operator 5, chat formatting in budgeted windows (DataFrame functions only).

Turns are written as ``<|im_start|>role\\ntext<|im_end|>\\n`` with control strings inside roles and texts escaped. A
turn has a token for every piece of at most ``PIECE`` code points of its runs of non-blanks, and ``TURN_TOKENS`` more.

Prefix sums of turn tokens cut a conversation into windows of whole turns. The system turn is set aside, and what it
leaves of ``BUDGET`` is the room of a window. Each turn starts in the cell of that many tokens in which its prefix sum
falls. The turns that also end in their cell are a window; the one that crosses its end joins them if there is room, and
is a window of its own otherwise. A window repeats the system turn and then the turn before it, each if it fits; repeated
turns stand first and carry no loss, so every assistant text is a target exactly once.

Bound: a window with its repeats holds at most ``BUDGET`` tokens, unless it is a single turn that alone holds more; such
windows are marked ``over``. A system turn of more than half the budget counts as any other turn and isn't repeated.

Defined results: null texts and roles are empty; turns order by turn (null first), then role, then text; rows with a
null conversation are one conversation; repeated rows are turns of their own; very long turns are written whole; an empty
table gives no rows; other columns, of whatever name, are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens of a window at most; code points of a piece; tokens of a turn besides its pieces.
BUDGET, PIECE, TURN_TOKENS = 256, 4, 4
PIECES = rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"
#: Turn numbers of a bucket of the two-level prefix sum; cells that one copy of a system turn is joined with.
BUCKET, CELLS = 256, 4096


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\\``, ``<|`` becomes ``<\|`` and a line break, in roles only, ``\^``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\^"))


def unescape(text: Column) -> Column:
    plain = lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\^"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def tokens(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(PIECES)) + TURN_TOKENS).cast("long")


def placed(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every turn with its rank, its cell, whether it crosses the cell's end, the system turn's tokens (0 without one),
    where the turn before it in another cell is wanted again (``next``), and the conversation's tokens (``total``)."""
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumns({"tokens": tokens(F.col("text")), "bucket": F.floor(F.coalesce(F.col("turn"), F.lit(-(1 << 62))) / BUCKET)})
    order = Window.partitionBy("key", "bucket").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({"at": F.sum("tokens").over(order) - F.col("tokens"), "rank": F.count(F.lit(1)).over(order) - 1})
    first = F.max(F.when((F.col("rank") == 0) & (F.col("role") == "system") & (F.col("tokens") <= BUDGET // 2), F.col("tokens")))
    sums = inside.groupBy("key", "bucket").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("m"), first.alias("first"))
    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("key", "bucket", (F.sum("n").over(upto) - F.col("n")).alias("before"), (F.sum("m").over(upto) - F.col("m")).alias("turns"), F.coalesce(F.first("first").over(upto), F.lit(0)).alias("system"), F.sum("n").over(Window.partitionBy("key")).alias("total"))
    joined = inside.join(sums, ["key", "bucket"]).withColumns({"at": F.col("before") + F.col("at"), "rank": F.col("turns") + F.col("rank")})
    cell = lambda at: F.floor(at / (F.lit(BUDGET) - F.col("system")))
    own = (F.col("rank") == 0) & (F.col("system") > 0)
    end = F.col("at") + F.col("tokens")
    again = ~own & (end < F.col("total")) & (cell(end - F.col("system")) != cell(F.col("at") - F.col("system")))
    return joined.select(
        "conv_id", "key", "rank", "role", "text", "tokens", "system", "total", F.when(own, 0).otherwise(cell(F.col("at") - F.col("system"))).alias("cell"),
        (~own & (cell(end - 1 - F.col("system")) != cell(F.col("at") - F.col("system")))).alias("crosses"), F.when(again, cell(end - F.col("system"))).alias("next"),
    )


def windows(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, window (numbers ascend), text, repeated (how many leading turns are repeats), loss (start and end, in code
    points, of the assistant texts that are targets), tokens (repeats included) and over."""
    rows = placed(turns, id_col, turn_col, role_col, text_col)
    own = (F.col("rank") == 0) & (F.col("system") > 0)
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    rows = rows.withColumns({"formatted": F.concat(head, body, F.lit(END)), "head": F.length(head), "body": F.length(body), "own": own})
    # part: 0 the system turn again, 1 the turn before again, 2 new
    item = lambda part: F.struct(part.alias("part"), "rank", "tokens", F.when(F.col("own"), 0).otherwise(F.col("tokens")).alias("room"), "crosses", "own", F.col("formatted").alias("text"), "head", "body", ((F.col("role") == "assistant") & (part == 2)).alias("target"))
    places = F.array(F.struct("cell", F.lit(2).alias("part")), F.struct(F.col("next").alias("cell"), F.lit(1).alias("part")))
    fresh = rows.withColumn("_in", F.explode(F.filter(places, lambda x: x["cell"].isNotNull()))).select("conv_id", "key", "system", F.col("_in.cell").alias("cell"), item(F.col("_in.part")).alias("item"))
    # The system turn goes to every later cell; a long conversation takes several copies, each for some of its cells.
    copies = F.floor(F.col("total") / (F.lit(BUDGET) - F.col("system")) / CELLS) + 1
    later = rows.filter((F.col("cell") > 0) & (F.col("system") > 0)).select("key", "cell", F.pmod("cell", copies).alias("copy")).distinct()
    first = rows.filter("own").select("conv_id", "key", "system", item(F.lit(0)).alias("item"), F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
    first = later.join(first, ["key", "copy"]).select("conv_id", "key", "system", "cell", "item")
    cells = fresh.unionByName(first).groupBy("conv_id", "key", "cell").agg(F.array_sort(F.collect_list("item")).alias("items"), F.max("system").alias("system"))
    new = F.filter("items", lambda x: x["part"] == 2)
    pick = lambda f: F.filter(new, f)
    cells = cells.select(
        "conv_id", "cell", "system", new.alias("new"), pick(lambda x: ~x["crosses"]).alias("inner"), pick(lambda x: x["crosses"]).alias("cross"),
        F.filter("items", lambda x: (x["part"] == 0) | x["own"]).alias("sys"), F.filter("items", lambda x: x["part"] == 1).alias("before"),
    )
    room = F.aggregate("new", F.lit(0).cast("long"), lambda a, x: a + x["room"])
    whole = (F.size("cross") == 0) | (F.size("inner") == 0) | (room <= F.lit(BUDGET) - F.col("system"))
    alone = (F.size("inner") == 0) & (F.size("cross") > 0)
    part = lambda number, turns_, before: F.struct(number.cast("long").alias("window"), turns_.alias("new"), before.alias("before"))
    last = F.filter(F.slice("inner", -1, 1), lambda x: ~x["own"])
    both = F.array(part(F.col("cell") * 2, F.col("inner"), F.col("before")), part(F.col("cell") * 2 + 1, F.col("cross"), last))
    split = cells.withColumn("w", F.explode(F.when(whole, F.array(part(F.col("cell") * 2 + alone.cast("int"), F.col("new"), F.col("before")))).otherwise(both)))
    used = lambda turns_: F.aggregate(turns_, F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    out = split.select("conv_id", "w.window", "w.new", "w.before", "sys", used(F.col("w.new")).alias("fresh"))
    none = F.slice("new", 1, 0)
    fits = ~F.exists("new", lambda x: x["own"]) & (used(F.col("sys")) + F.col("fresh") <= BUDGET)
    out = out.withColumn("sys", F.when(fits, F.col("sys")).otherwise(none))
    out = out.withColumn("before", F.when(used(F.col("sys")) + used(F.col("before")) + F.col("fresh") <= BUDGET, F.col("before")).otherwise(none))
    again = F.transform(F.concat("sys", "before"), lambda x: x.withField("target", F.lit(False)))
    out = out.select("conv_id", "window", F.concat(again, "new").alias("turns"), F.size(again).alias("repeated"))
    spans = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("loss"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["head"]
        span = F.array(F.struct(begin.alias("start"), (begin + x["body"]).alias("end"))).cast(spans)
        return F.struct((acc["at"] + F.length(x["text"])).alias("at"), F.when(x["target"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"))

    return out.select(
        "conv_id", "window", F.array_join(F.transform("turns", lambda x: x["text"]), "").alias("text"), "repeated",
        F.aggregate("turns", zero, step, lambda acc: acc["loss"]).alias("loss"), used(F.col("turns")).alias("tokens"), (used(F.col("turns")) > BUDGET).alias("over"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all from the windows' texts, with the
    number of windows and of those over the budget."""
    pieces = F.filter(F.split("text", r"<\|im_end\|>\n", -1), lambda p: F.length(p) > 0)
    fresh = F.slice(pieces, F.col("repeated") + 1, F.greatest(F.size(pieces) - F.col("repeated"), F.lit(0)))
    role = lambda p: unescape(F.substring_index(F.substring(p, len(START) + 1, 1 << 30), "\n", 1))

    def turn(p: Column) -> Column:
        body = F.substring(p, len(START) + 1, 1 << 30)
        return F.concat(role(p), F.lit("\n"), unescape(body.substr(F.instr(body, "\n") + 1, F.length(body))), F.lit("\n"))

    loss = F.array_join(F.transform("loss", lambda s: unescape(F.col("text").substr(s["start"] + 1, s["end"] - s["start"]))), "")
    each = formatted.select("conv_id", "window", F.size(fresh).cast("long").alias("n"), F.array_join(F.transform(fresh, turn), "").alias("turns"), loss.alias("loss"), F.length("text").cast("long").alias("chars"), F.col("over").cast("long").alias("over"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"), F.sum("over").alias("n_over"))
    text = lambda k: F.array_join(F.transform("w", lambda x: x[k]), "")
    return whole.select("conv_id", "n_turns", F.sha2(text("turns"), 256).alias("turns_sha256"), F.length(text("loss")).cast("long").alias("loss_chars"), F.sha2(text("loss"), 256).alias("loss_sha256"), "formatted_chars", "n_windows", "n_over")


#: The same digests in DuckDB, over ``conversations`` and the conversation that the query adds.
SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, CAST(len(regexp_extract_all(text, '{PIECES}')) + {TURN_TOKENS} AS BIGINT) AS tokens,
    {len(START)} + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\^')) + 1
      + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + {len(END)} AS chars
  FROM turns
), summed AS (
  SELECT *, sum(tokens) OVER w AS upto, row_number() OVER w AS place,
    coalesce(first_value(CASE WHEN role = 'system' AND tokens <= {BUDGET // 2} THEN tokens END) OVER w, 0) AS sys
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
), celled AS (
  SELECT *, place = 1 AND sys > 0 AS own, CASE WHEN place = 1 AND sys > 0 THEN 0 ELSE (upto - tokens - sys) // ({BUDGET} - sys) END AS cell,
    NOT (place = 1 AND sys > 0) AND (upto - 1 - sys) // ({BUDGET} - sys) <> (upto - tokens - sys) // ({BUDGET} - sys) AS crosses
  FROM summed
), cut AS (
  SELECT *, 2 * cell + CASE WHEN crosses AND (count(*) FILTER (NOT crosses) OVER c = 0
    OR sum(CASE WHEN own THEN 0 ELSE tokens END) OVER c > {BUDGET} - sys) THEN 1 ELSE 0 END AS win
  FROM celled WINDOW c AS (PARTITION BY conv_id, cell)
), windowed AS (
  SELECT conv_id, win, min(place) - 1 AS before, sum(tokens) AS fresh, sum(chars) AS chars, bool_or(own) AS has_sys, max(sys) AS sys FROM cut GROUP BY conv_id, win
), repeated AS (
  SELECT w.conv_id, w.fresh, w.chars, CASE WHEN w.sys > 0 AND NOT w.has_sys AND w.sys + w.fresh <= {BUDGET} THEN w.sys ELSE 0 END AS sys_tokens,
    s.chars AS sys_chars, CASE WHEN p.own THEN 0 ELSE coalesce(p.tokens, 0) END AS hist_tokens, p.chars AS hist_chars
  FROM windowed w LEFT JOIN cut p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.place = w.before
    LEFT JOIN cut s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.place = 1
), written AS (
  SELECT conv_id, CAST(sum(chars + CASE WHEN sys_tokens > 0 THEN sys_chars ELSE 0 END
      + CASE WHEN hist_tokens > 0 AND sys_tokens + hist_tokens + fresh <= {BUDGET} THEN hist_chars ELSE 0 END) AS BIGINT) AS formatted_chars,
    count(*) AS n_windows, CAST(count(*) FILTER (fresh > {BUDGET}) AS BIGINT) AS n_over
  FROM repeated GROUP BY conv_id
), digests AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256
  FROM cut GROUP BY conv_id
)
SELECT d.*, formatted_chars, n_windows, n_over FROM digests d JOIN written w ON w.conv_id IS NOT DISTINCT FROM d.conv_id
"""
