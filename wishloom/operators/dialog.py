"""Folding dialogue turns of a session.

Turns carry: session, turn, language, from_codes, to_ids, departure_dates
(arrays), duration_id, adults, non_adults, rooms. Null or empty means the turn
said nothing about it. A session may be arbitrarily long: folds are
aggregates, never a whole session in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.messages import choose_prompt
from ..plans.scale import global_position, running, unnest
from . import normalisation as nm

LISTS = ["from_codes", "to_ids"]


def with_defaults(turns: DataFrame) -> DataFrame:
    """Every turn restates the defaults for what it does not mention."""
    return turns.withColumns({
        "duration_id": nm.default_duration(F.col("duration_id")),
        "_party": nm.default_party(F.col("adults"), F.col("non_adults")),
        "rooms": nm.default_rooms(F.col("rooms"))}).withColumns({
        "adults": F.col("_party.adults"), "non_adults": F.col("_party.nonAdults")}).drop("_party")


def first_mentions(turns: DataFrame) -> DataFrame:
    """(session, field, value, turn, pos): where each list value first occurs."""
    entries = F.flatten(F.array(*[
        F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), _entry(c)) for c in LISTS]))
    flat = turns.select("session", "turn", F.inline(entries))
    return flat.groupBy("session", "field", "value").agg(F.min(F.struct("turn", "pos")).alias("at")).select(
        "session", "field", "value", "at.turn", "at.pos")


def _entry(field: str):
    def build(value, position):
        return F.struct(F.lit(field).alias("field"), value.alias("value"), position.alias("pos"))
    return build


def fold(turns: DataFrame, defaults_override: bool = False) -> DataFrame:
    """One payload per session: lists unite, the last given scalar wins.

    With defaults_override a turn that names no duration, party or rooms
    resets them to the defaults; without it earlier answers stand.
    """
    rows = with_defaults(turns) if defaults_override else turns

    def last(name, given: Column | None = None):
        c = F.col(name)
        return F.max_by(c, F.when(c.isNotNull() if given is None else given, F.col("turn"))).alias(name)

    scalars = rows.groupBy("session").agg(
        F.count(F.lit(1)).alias("turns"), last("language"), last("departure_dates", F.size("departure_dates") > 0),
        last("duration_id", F.coalesce(F.trim("duration_id"), F.lit("")) != ""), last("adults"), last("non_adults"), last("rooms"))
    # distinct values per session and field: bounded by the gazetteer
    lists = first_mentions(rows).groupBy("session").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == c, F.struct("turn", "pos", "value")))),
                    lambda e: e["value"]).alias(c) for c in LISTS])
    none = F.array().cast("array<string>")
    joined = scalars.join(lists, "session", "left")
    return joined.withColumns({
        **{c: F.coalesce(c, none) for c in [*LISTS, "departure_dates"]},
        "duration_id": nm.default_duration(F.col("duration_id")),
        "party": nm.default_party(F.col("adults"), F.col("non_adults")), "rooms": nm.default_rooms(F.col("rooms")),
    }).drop("adults", "non_adults")


def outcome(folded: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Re-validate folded sessions; adds error, prompt and status."""
    rows = folded
    if calendar is not None:
        rows = nm.first_off_calendar(folded, calendar, "session")
    off = F.col("off_calendar") if calendar is not None else F.lit(None).cast("string")
    c = F.col
    error = F.coalesce(
        nm.multi_select_error(c("from_codes"), c("to_ids")), nm.date_error(c("departure_dates"), off),
        nm.destination_error(c("to_ids")), nm.duration_error(c("duration_id")),
        nm.party_error(c("party.adults"), c("party.nonAdults")), nm.rooms_error(c("rooms")),
        nm.combination_error(c("from_codes"), c("to_ids"), c("departure_dates")))
    staged = rows.withColumn("error", error).withColumn("prompt", choose_prompt(F.array("error")))
    return staged.withColumn("status", F.when(F.col("error").isNull(), "success").when(
        F.col("prompt").isNotNull(), "clarification").otherwise("failed")).drop("off_calendar")


def transcripts(turns: DataFrame, chunk_turns: int = 256) -> tuple[DataFrame, DataFrame]:
    """Transcripts of every turn of every session, in space linear in the turns.

    Returns chunks (session, chunk, entries): consecutive turns of a session as
    (turn, role, text), at most `chunk_turns` of them, each turn in one chunk; and pointers
    (session, turn, chunk, length): the transcript up to a turn is that of all
    earlier chunks and the first `length` entries of its own. A chunk is the
    only thing that is collected, so a session of any length spreads over tasks.
    """
    placed = global_position(turns.select("session", "turn", "role", "text"), ["turn"], ["session"], "_at")
    chunk = F.floor(F.col("_at") / chunk_turns).cast("long")
    pointers = placed.select("session", "turn", chunk.alias("chunk"), (F.col("_at") % chunk_turns + 1).cast("int").alias("length"))
    entries = F.array_sort(F.collect_list(F.struct("_at", "turn", "role", "text")))
    chunks = placed.groupBy("session", chunk.alias("chunk")).agg(F.transform(entries, lambda e: F.struct(
        e["turn"].alias("turn"), e["role"].alias("role"), e["text"].alias("text"))).alias("entries"))
    return chunks, pointers


def transcript_entries(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """(session, turn, said, role, text): the transcript up to each asked pointer, one row per entry."""
    up_to = asked.select("session", "turn", F.col("chunk").alias("_last"), "length")
    met = chunks.join(up_to, "session").where("chunk <= _last")
    shown = F.when(F.col("chunk") == F.col("_last"), F.slice("entries", F.lit(1), F.col("length"))).otherwise(F.col("entries"))
    listed = F.transform(shown, lambda e: F.struct(e["turn"].alias("said"), e["role"].alias("role"), e["text"].alias("text")))
    return unnest(met.select("session", "turn", listed.alias("_e")), "_e", "session", "turn")


def turn_metadata(turns: DataFrame) -> DataFrame:
    """Per turn: user turn number, transcript length, last system prompt, language, missing fields.

    turns also carries role and text; `transcripts` has what was said up to a turn.
    """
    firsts = first_mentions(turns).groupBy("session", "turn").agg(*[
        F.count_if(F.col("field") == c).alias(f"_new_{c}") for c in LISTS])
    rows = turns.join(firsts, ["session", "turn"], "left")
    user = (F.col("role") == "user").cast("int")
    walked = running(
        rows, ["session"], ["turn"],
        sums={"user_turn": user, "transcript_length": F.lit(1), "_dates": (F.size("departure_dates") > 0).cast("int"),
              **{f"_n_{c}": F.coalesce(F.col(f"_new_{c}"), F.lit(0)) for c in LISTS}},
        lasts={"last_prompt": F.when(F.col("role") == "system", F.col("text")), "session_language": F.col("language")})
    missing = F.array_compact(F.array(
        F.when(F.col("_dates") == 0, "departureDate"), F.when(F.col("_n_from_codes") == 0, "from"), F.when(F.col("_n_to_ids") == 0, "to")))
    return walked.withColumn("missing_parameters", missing).drop(
        "_dates", *[f"_n_{c}" for c in LISTS], *[f"_new_{c}" for c in LISTS])
