"""Chat formatting with typed content parts.

A message holds an array of parts (type, text, uri, width, height, seconds, pages). A visitor gives for
each type its rendering: text stands as it is; an image, audio or document part becomes a placeholder
numbered in the conversation's order, an attachment reference, and the number of tokens that the
placeholder expands to. Everything is Catalyst expressions, with one shuffle, by conversation.

Defined results: messages are ordered by (turn, role, parts), nulls first, and repeated rows stay as so
many messages; a null role is 'unknown'; null or empty parts give an empty message; a null text is empty; parts of an
unknown type render as <|unsupported:type|>, without tokens or attachment; missing sizes count as 0; a null conv_id
is a conversation of its own; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PATCH = 28
AUDIO_RATE = 12.5
PAGE_TOKENS = 256
WORDS = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


class PartVisitor:
    """What each type of part becomes. Subclass it to change a model's conventions."""

    attached = ("image", "audio", "document")

    def text_tokens(self, p: Column) -> Column:
        return F.regexp_count(F.coalesce(p["text"], F.lit("")), F.lit(WORDS)).cast("long")

    def image_tokens(self, p: Column) -> Column:
        side = lambda c: F.ceil(F.coalesce(p[c], F.lit(0)) / PATCH)
        return (side("width") * side("height") + 2).cast("long")

    def audio_tokens(self, p: Column) -> Column:
        return (F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * F.lit(AUDIO_RATE)) + 2).cast("long")

    def document_tokens(self, p: Column) -> Column:
        return (F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS + 2).cast("long")

    def tokens(self, p: Column) -> Column:
        out = F.when(p["type"] == "text", self.text_tokens(p))
        for kind in self.attached:
            out = out.when(p["type"] == kind, getattr(self, f"{kind}_tokens")(p))
        return out.otherwise(F.lit(0).cast("long"))

    def render(self, p: Column, number: Column) -> Column:
        return (
            F.when(p["type"] == "text", F.coalesce(p["text"], F.lit("")))
            .when(p["type"].isin(*self.attached), F.concat(F.lit("<|"), p["type"], F.lit("_"), number.cast("string"), F.lit("|>")))
            .when(p.isNotNull(), F.concat(F.lit("<|unsupported:"), F.coalesce(p["type"], F.lit("null")), F.lit("|>")))
            .otherwise("")
        )


def format_chat(messages: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """(conv_id, prompt, attachments, n_messages, n_text_tokens, n_expanded_tokens) of messages
    (conv_id, turn, role, parts). An attachment reference is 'number type uri tokens'."""
    v = visitor or PartVisitor()
    talk = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "parts"))).alias("all"))
    rows = talk.select("conv_id", F.posexplode("all").alias("m", "msg"))
    rows = rows.select("conv_id", "m", F.coalesce("msg.role", F.lit("unknown")).alias("role"), F.posexplode_outer("msg.parts").alias("k", "p"))
    order = Window.partitionBy("conv_id").orderBy("m", "k").rowsBetween(Window.unboundedPreceding, 0)
    p = F.col("p")
    rows = rows.withColumn("attached", F.coalesce(p["type"].isin(*v.attached), F.lit(False))).withColumn("number", F.sum(F.col("attached").cast("int")).over(order))
    rows = rows.withColumn("tokens", v.tokens(p))
    head = F.when(F.coalesce("k", F.lit(0)) == 0, F.concat(F.when(F.col("m") > 0, "<|end|>\n").otherwise(""), F.lit("<|"), "role", F.lit("|>\n"))).otherwise("")
    rows = rows.withColumn("piece", F.concat(head, v.render(p, F.col("number"))))
    note = F.when(F.col("attached"), F.concat_ws(" ", F.col("number").cast("string"), p["type"], F.coalesce(p["uri"], F.lit("-")), F.col("tokens").cast("string")))
    rows = rows.select("conv_id", "m", F.struct("m", F.coalesce("k", F.lit(0)).alias("k"), "piece", note.alias("note")).alias("x"), "attached", "tokens")
    out = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("x")).alias("x"),
        (F.max("m") + 1).cast("long").alias("n_messages"),
        F.sum(F.when(~F.col("attached"), F.col("tokens")).otherwise(0)).alias("n_text_tokens"),
        F.sum("tokens").alias("n_expanded_tokens"),
    )
    return out.select(
        "conv_id",
        F.concat(F.array_join("x.piece", ""), F.lit("<|end|>\n")).alias("prompt"),
        F.array_join("x.note", "\n").alias("attachments"),
        "n_messages", "n_text_tokens", "n_expanded_tokens",
    )


def parts_of(turns: DataFrame) -> DataFrame:
    """Typed parts for the plain turns of ``conversations``: a text part for each line, and before them,
    by the numbers of the turn, an image, an audio or a document part."""
    n = F.length("text")
    part = lambda **kw: F.struct(*[kw.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (x.split(":") for x in PART[7:-1].split(","))])
    at = lambda scheme: F.concat(F.lit(scheme), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    image = F.when((F.col("role") == "user") & (F.col("conv_id") % 3 == 0), part(type=F.lit("image"), uri=at("img://"), width=64 + n % 512, height=64 + F.col("conv_id") % 256))
    audio = F.when((F.col("role") == "user") & (F.col("conv_id") % 5 == 0), part(type=F.lit("audio"), uri=at("snd://"), seconds=n / F.lit(16.0)))
    document = F.when((F.col("role") == "system") & (F.col("conv_id") % 2 == 0), part(type=F.lit("document"), uri=at("doc://"), pages=1 + n % 7))
    lines = F.transform(F.split("text", "\n"), lambda x: part(type=F.lit("text"), text=x))
    media = F.filter(F.array(image, audio, document), lambda x: x.isNotNull())
    return turns.select("conv_id", "turn", "role", F.concat(media, F.coalesce(lines, F.array().cast(f"array<{PART}>"))).alias("parts"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(parts_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


SQL = r"""
with turns as (
  select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text) - 1 m, coalesce(length(text), 0) n from conversations
), part as (
  select conv_id, m, role, 0 k, 'image' kind, 'img://' || conv_id || '/' || turn uri, '' txt, cast(ceil((64 + n % 512) / 28e0) * ceil((64 + conv_id % 256) / 28e0) + 2 as bigint) tokens from turns where role = 'user' and conv_id % 3 = 0
  union all
  select conv_id, m, role, 1, 'audio', 'snd://' || conv_id || '/' || turn, '', cast(ceil(n / 16e0 * 12.5e0) + 2 as bigint) from turns where role = 'user' and conv_id % 5 = 0
  union all
  select conv_id, m, role, 2, 'document', 'doc://' || conv_id || '/' || turn, '', cast((1 + n % 7) * 256 + 2 as bigint) from turns where role = 'system' and conv_id % 2 = 0
  union all
  select conv_id, m, role, 3 + i, 'text', null, line, cast(len(regexp_extract_all(line, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) as bigint)
  from (select conv_id, m, role, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) i from turns where text is not null)
  union all
  select conv_id, m, role, 1000000, 'none', null, '', 0 from turns where text is null
), numbered as (
  select *, sum(case when kind in ('image', 'audio', 'document') then 1 else 0 end) over (partition by conv_id order by m, k rows unbounded preceding) num,
    row_number() over (partition by conv_id, m order by k) pos from part
)
select conv_id,
  string_agg(case when pos = 1 then (case when m > 0 then '<|end|>' || chr(10) else '' end) || '<|' || coalesce(role, 'unknown') || '|>' || chr(10) else '' end
    || case when kind in ('text', 'none') then txt else '<|' || kind || '_' || num || '|>' end, '' order by m, k) || '<|end|>' || chr(10) prompt,
  coalesce(string_agg(case when kind not in ('text', 'none') then num || ' ' || kind || ' ' || uri || ' ' || tokens end, chr(10) order by m, k), '') attachments,
  cast(max(m) + 1 as bigint) n_messages,
  cast(sum(case when kind = 'text' then tokens else 0 end) as bigint) n_text_tokens,
  cast(sum(tokens) as bigint) n_expanded_tokens
from numbered group by conv_id
"""
