r"""Chat formatting of typed content parts, in DataFrame operations only.

A turn's content is a list of parts, each of a kind (``text``, ``image``, ``audio``,
``document``). A visitor goes over the parts of a conversation in order: text is escaped
and kept in place, any other part becomes a placeholder ``<kind:ordinal>``, numbered
through the whole conversation. Its reference is recorded beside the formatted text:
ordinal, kind, uri, units, the tokens it will expand to, the turn it stands in (from 0)
and its place in the formatted text, so ``parse_chat`` can restore every part.

Template: ``<turn:ROLE>CONTENT</turn>\n`` per turn. In roles and texts ``\`` is written
``\0``, ``<`` is ``\1`` and ``>`` is ``\2``, so no control string can occur in them;
undoing it in the order 2, 1, 0 gives the text back exactly.

Ordinals and places are running sums over a conversation's parts (windows), so the work
grows in proportion to the parts, however many one conversation has.

Cases: a null role or text is empty; a null list of parts has none; null or unknown
kinds count as text; null units count as one; turns are ordered by turn number (nulls
first), ties by role and parts; rows that repeat are repeated turns; a null conv_id is
one conversation; an empty table gives no conversations; other columns are ignored.
A conversation is one output row, so its turns meet in one task by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
#: Tokens that one unit of an attachment expands to: image tiles, seconds of sound, pages.
EXPANSION = {"image": 256, "audio": 25, "document": 1024}
PARTS = "array<struct<kind:string,text:string,uri:string,units:int>>"


def escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, code in (("\\", "\\0"), ("<", "\\1"), (">", "\\2")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    for plain, code in ((">", "\\2"), ("<", "\\1"), ("\\", "\\0")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def text_parts(text: Column) -> Column:
    """A plain text as the typed parts of a turn: one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(0).alias("units")))


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*EXPANSION), F.lit(False))


def visited(turns: DataFrame) -> DataFrame:
    """One row per part (one for a turn without any): its number ``_t`` of turn and ``_i`` in it, what is written, the ordinal, where it begins."""
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    numbered = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(PARTS)).alias("parts"))
    numbered = numbered.select("*", F.row_number().over(in_order).alias("_t"), F.size("parts").alias("_n"))
    each = numbered.select("conv_id", "role", "_t", "_n", F.posexplode_outer("parts").alias("_i", "part"))
    each = each.select("conv_id", "role", "_t", "_n", F.coalesce("_i", F.lit(0)).alias("_i"), "part", is_attachment(F.col("part")).alias("_a"))
    so_far = Window.partitionBy("conv_id").orderBy("_t", "_i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("ordinal", F.when(F.col("_a"), F.count_if("_a").over(so_far)))
    placeholder = F.concat(F.lit("<"), F.col("part.kind"), F.lit(":"), F.col("ordinal").cast("string"), F.lit(">"))
    each = each.withColumn("written", F.when(F.col("_a"), placeholder).otherwise(escape(F.col("part.text"))))
    head = F.when(F.col("_i") == 0, F.concat(F.lit("<turn:"), escape(F.col("role")), F.lit(">"))).otherwise("")
    end = F.when(F.col("_i") >= F.col("_n") - 1, END).otherwise("")
    each = each.select("*", head.alias("_head"), end.alias("_end"))
    size = F.char_length("_head") + F.char_length("written") + F.char_length("_end")
    return each.withColumn("start", F.sum(size.cast("long")).over(so_far) - F.char_length("_end") - F.char_length("written"))


def format_chat(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """Per conversation: ``formatted``, ``loss`` spans, ``attachments``, ``expanded_tokens``.

    ``turns`` has conv_id, turn, role and parts (``PARTS``). ``loss`` lists start (code
    points from 0) and length of each content of ``learn_role``. ``expanded_tokens`` are
    those of the attachments alone; the text's depend on the tokenizer.
    """
    units = F.coalesce(F.col("part.units"), F.lit(1)).cast("long")
    tokens = units * sum((F.when(F.col("part.kind") == k, n).otherwise(0) for k, n in EXPANSION.items()), F.lit(0))
    reference = F.struct(
        F.col("ordinal").cast("long").alias("ordinal"), F.col("part.kind").alias("kind"), F.col("part.uri").alias("uri"), F.col("part.units").alias("units"),
        tokens.alias("tokens"), (F.col("_t") - 1).cast("long").alias("turn"), F.col("start").alias("offset"),
    )
    piece = F.struct("_i", F.concat("_head", "written", "_end").alias("s"))
    turn = visited(turns).groupBy("conv_id", "_t", "role").agg(
        F.sort_array(F.collect_list(piece)).alias("pieces"), F.min("start").alias("start"), F.sum(F.char_length("written").cast("long")).alias("length"),
        F.sort_array(F.collect_list(F.when(F.col("_a"), reference))).alias("refs"),
    )
    text = F.concat_ws("", F.transform("pieces", lambda p: p["s"]))
    span = F.when(F.col("role") == learn_role, F.struct("start", "length"))
    convs = turn.select("conv_id", "_t", text.alias("s"), span.alias("span"), "refs").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("_t", "s"))).alias("texts"), F.sort_array(F.collect_list("span")).alias("loss"), F.flatten(F.sort_array(F.collect_list("refs"))).alias("attachments"),
    )
    return convs.select(
        "conv_id", F.concat_ws("", F.transform("texts", lambda t: t["s"])).alias("formatted"), "loss", "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, r: n + r["tokens"]).alias("expanded_tokens"),
    )


def parse_chat(formatted: Column) -> Column:
    """Turns (role, text) read back from the formatted text; placeholders stay as written."""
    pieces = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")
    role = lambda p: F.substring_index(F.substr(p, F.lit(len("<turn:") + 1)), ">", 1)
    return F.transform(pieces, lambda p: F.struct(
        unescape(role(p)).alias("role"), unescape(F.substr(p, F.char_length(role(p)) + len("<turn:") + 2)).alias("text"),
        F.substr(p, F.char_length(role(p)) + len("<turn:") + 2).alias("content"),
    ))


def parse_parts(formatted: Column, attachments: Column) -> Column:
    """Turns (role, parts) read back: texts unescaped, placeholders as the attachments of their ordinals.

    Empty texts leave no part, and texts side by side come back as one.
    """
    def part(piece):
        ordinal = F.regexp_extract(piece, r"^<[a-z]+:(\d+)>$", 1)
        at = F.get(attachments, ordinal.cast("int") - 1)
        return F.when(F.startswith(piece, F.lit("<")), F.struct(at["kind"].alias("kind"), F.lit(None).cast("string").alias("text"), at["uri"].alias("uri"), at["units"].alias("units"))).otherwise(
            F.struct(F.lit("text").alias("kind"), unescape(piece).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("units"))
        )

    pieces = lambda content: F.filter(F.split(content, "(?=<)|(?<=>)"), lambda x: x != "")
    return F.transform(parse_chat(formatted), lambda t: F.struct(t["role"].alias("role"), F.transform(pieces(t["content"]), part).alias("parts")))


def op7_typed_parts_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("long").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"),
    )
    turns = table.unionByName(extra).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    chats = format_chat(turns).select("*", parse_chat(F.col("formatted")).alias("back"))
    learned = F.concat_ws("", F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))))
    out = chats.select("conv_id", "formatted", "back", learned.alias("learned"))
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
, e AS (SELECT *, length(role) + length(text) + 15
    + length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '>', '')) AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
