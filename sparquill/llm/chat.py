"""Chat formatting by perspective rotation: a dialogue is rendered once for each of its participants.

That speaker is the assistant, the others are named users, the system prompt stays. The mask has the
stretches that the assistant wrote, end marks included. All of it is built-in expressions; one
shuffle brings the turns of a conversation together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = "<|end|>"
SYSTEM = "system"


def escaped(text: F.Column) -> F.Column:
    """A text that holds no mark: every "<|" in it has a backslash more between its two characters, which can be taken out again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escaped_name(name: F.Column) -> F.Column:
    """A name in which backslashes, bars and line breaks are written with a backslash, so that it ends no mark."""
    return F.replace(F.regexp_replace(name, r"([\\|])", r"\\$1"), F.lit("\n"), F.lit("\\n"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_col, speaker, n_turns, n_own, rendered, mask)``, a row for each participant of a conversation.

    ``mask`` is an array of (begin, end) in characters of ``rendered``, end exclusive. Turns go by number, a null
    number first; of turns with one number the lesser role (a null one first), then the lesser text, comes first. Every
    row is a turn, also one that repeats another. A null role is a participant without a name, whose speaker is null;
    a null text is empty. Marks within texts and names are escaped, so that no text makes a turn. A conversation of
    system turns alone has no participant and gives no row, and neither do rows with a null conversation, nor an empty
    table. Extra columns are left out. A conversation is one row, so it has to fit in memory, as each rendering has.
    """
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where("conv IS NOT NULL")
    rows = rows.withColumn("name", escaped_name(F.col("role"))).withColumn("body", F.concat(escaped(F.col("text")), F.lit(END)))
    turn = F.struct(F.col("turn").isNotNull().alias("has"), "turn", F.col("role").isNotNull().alias("named"), "role", "text", "name", "body")
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.withColumn("speaker", F.explode(F.expr(f"array_distinct(transform(filter(turns, t -> NOT t.role <=> '{SYSTEM}'), t -> t.role))")))
    parts = f"""transform(turns, t -> struct(
        concat(CASE WHEN t.role = '{SYSTEM}' THEN '<|system|>' WHEN t.role <=> speaker THEN '<|assistant|>' WHEN t.role IS NULL THEN '<|user|>' ELSE concat('<|user name=', t.name, '|>') END, '\\n') AS head,
        t.body AS body, t.role <=> speaker AS own))"""
    whole = whole.select("conv", "speaker", F.expr(parts).alias("parts"))
    spans = """aggregate(parts, struct(0 AS at, array(struct(0 AS begin, 0 AS end)) AS spans), (s, p) -> struct(
        s.at + length(p.head) + length(p.body) + 1 AS at,
        if(p.own, concat(s.spans, array(struct(s.at + length(p.head) AS begin, s.at + length(p.head) + length(p.body) AS end))), s.spans) AS spans),
        s -> slice(s.spans, 2, greatest(size(s.spans) - 1, 1)))"""
    return whole.select(
        F.col("conv").alias(conv_col),
        "speaker",
        F.size("parts").alias("n_turns"),
        F.expr("size(filter(parts, p -> p.own))").alias("n_own"),
        F.expr("array_join(transform(parts, p -> concat(p.head, p.body, '\\n')), '')").alias("rendered"),
        F.expr(spans).alias("mask"),
    )


def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side; the mask as text, "begin-end" joined by commas."""
    out = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.withColumn("mask", F.expr("array_join(transform(mask, m -> concat(m.begin, '-', m.end)), ',')"))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') || '<|end|>' AS body,
    replace(regexp_replace(role, '([\\|])', '\\\1', 'g'), chr(10), '\n') AS name, row_number() OVER () AS nth
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role IS DISTINCT FROM 'system'),
s AS (
  SELECT t.conv_id, p.speaker, t.turn, t.role, t.text, t.body, t.nth, t.role IS NOT DISTINCT FROM p.speaker AS own,
    CASE WHEN t.role = 'system' THEN '<|system|>' WHEN t.role IS NOT DISTINCT FROM p.speaker THEN '<|assistant|>'
         WHEN t.role IS NULL THEN '<|user|>' ELSE '<|user name=' || t.name || '|>' END || chr(10) AS head
  FROM t JOIN p USING (conv_id)),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
      PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role NULLS FIRST, text, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM s)
SELECT conv_id, speaker, count(*)::INTEGER AS n_turns, (count(*) FILTER (WHERE own))::INTEGER AS n_own,
  string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text, nth) AS rendered,
  string_agg((pos + length(head)) || '-' || (pos + length(head) + length(body)), ',' ORDER BY turn NULLS FIRST, role NULLS FIRST, text, nth) FILTER (WHERE own) AS mask
FROM o GROUP BY conv_id, speaker
"""
