"""Clean speaker turns from transcript lines.

Line layouts are mined with a fixed-depth token tree: a line field's tokens lead to a leaf by their number, the first and the last token
(each level has a bounded number of branches, all rarer tokens share one), and within a leaf the positions whose tokens vary are
slots. What a slot holds is inferred from the data: digits are a clock if they agree with start_seconds, a speaker's number if the talk
has so many speakers, words are a speaker if they are names of the talk's. Extraction then follows the layouts, and merging follows
the order of the clock in blocks of a talk, so that a long talk isn't one task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.ordered import prefix_sum
from weftline.session import cut

BRANCHES = 200
BLOCK_SECONDS = 600

_WORD = r"(\p{L}[\p{L}\p{M}'’]*|[0-9]+|[^\s\p{L}\p{M}\p{N}])"
_CLOCK = r"\[?\(?\b[0-9]{1,3}:[0-5]?[0-9](?::[0-5]?[0-9])?(?:[.,][0-9]+)?\b\)?\]?"
_SOUND = r"\[[^\]]*\]|【[^】]*】|\{[^}]*\}|<[^>]*>|♪[^♪]*♪|♪|\*[^*]+\*|[(（][^()（）.!?。！？]*[)）]|-->|" + _CLOCK
#: Sounds in round brackets, which otherwise are the speaker's own; the other brackets hold nothing else. Fixed values.
_NAMED_SOUNDS = "aplausos|risas|música|musica|inaudible|ruido de fondo|applause|laughter|music|background noise|risos|inaudível|inaudivel|applaudissements|rires|musique|Applaus|Gelächter|Musik|unverständlich|аплодисменты|смех|музыка|неразборчиво|拍手|笑い|音楽|掌声|笑声|音乐|تصفيق|ضحك|موسيقى|तालियाँ|हँसी|संगीत|เสียงปรบมือ|เสียงหัวเราะ|ดนตรี"
_SOUND_ONLY = r"(?iu)\[[^\]]*\]|【[^】]*】|\{[^}]*\}|<[^>]*>|♪[^♪]*♪|♪|\*[^*]+\*|[(（](?:" + _NAMED_SOUNDS + r")(?:\s*[0-9:]+)?[)）]|-->|" + _CLOCK
#: Hesitation sounds of the languages. Fixed values.
_UM = "eh|em|este|m+|er|uh|um|hm+|hum|hã|ha|ah|ahn|euh|heu|äh|ähm|ahm|э-э|э|эм|мм|えーと|えと|あのー|あの|うーん|うん|呃|嗯|唔|آه|اه|ا?ممم|अम्म|उम्म|हम्म|เอ่อ|อืม"
_UM_IN_TEXT = "eh|em|mmm+|er|uh|um|hmm+|hum|hã|ahn|euh|heu|äh|ähm|hm|э-э|эм|мм|えーと|あのー|うーん|呃|嗯|唔|آه|ممم|अम्म|उम्म|हम्म|เอ่อ|อืม"
_HEAD = r"^[\s\ufeff]*(?:" + _CLOCK + r"\s*)?((?:[^:：\s.!?,]+\.?\s+){0,3}[^:：\s.!?,]+(?:,\s*[^:：\s.!?,]+)?)\s*[:：]"


def _bare(text: Column) -> Column:
    """Lower case, accents and marks gone."""
    accented, plain = "áàâãäåéèêëíìîïóòôõöúùûüýñç", "aaaaaaeeeeiiiiooooouuuuync"
    return F.regexp_replace(F.translate(F.lower(text), accented, plain), r"\p{M}", "")


#: A whole text of nothing but sounds, clocks, hesitations and signs. It fails at the first spoken word, so most texts are left early.
_SILENT = rf"(?iu)^(?:{_SOUND}|(?:{_UM})\p{{M}}*(?![\p{{L}}\p{{M}}\p{{N}}])|[^\p{{L}}\p{{N}}])*+$"


def is_spoken(text: Column) -> Column:
    """Whether letters or digits are left besides sound annotations, clock marks and hesitation sounds; false for null."""
    return F.coalesce(~text.rlike(_SILENT), F.lit(False))


def spoken_words(text: Column) -> Column:
    """The text without annotations, clocks and hesitations, repeated words once, white space collapsed."""
    left = F.regexp_replace(F.replace(text, F.lit("\ufeff"), F.lit("")), _SOUND_ONLY, " ")
    left = F.regexp_replace(left, rf"(?iu)(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{_UM_IN_TEXT})(?![\p{{L}}\p{{M}}\p{{N}}])(?:\s*(?:,|，|、|\.\.\.|…))?", " ")
    left = F.regexp_replace(left, r"(?iu)(?<![\p{L}\p{M}])([\p{L}\p{M}]+)(?:\s+\1(?![\p{L}\p{M}]))+", "$1")
    left = F.regexp_replace(left, r"[\s\p{Z}]+", " ")
    left = F.regexp_replace(left, r" ?, ?(?=[,.!?])| (?=[,.!?](?:\s|$))", "")
    return F.trim(F.regexp_replace(left, r"^[ ,，、.…]+", ""))


# --- layouts -----------------------------------------------------------------------------------------------------


def _climbed(labels: DataFrame) -> DataFrame:
    """labels whose first and last tokens stand for the tree's branches: a token of at least one in BRANCHES lines has one, all others share '*'."""
    each = labels.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("which"), F.col(c).alias("token")) for c in ("first", "last")])).alias("_t"))
    total = (labels.agg(F.sum("n")).first()[0] or 0) / BRANCHES
    own = each.groupBy("_t.which", "_t.token").agg(F.sum("n").alias("n")).where(F.col("n") >= total).collect()  # at most BRANCHES of each
    for c in ("first", "last"):
        labels = labels.withColumn(c, F.when(F.col(c).isin([t for which, t, _ in own if which == c]), F.col(c)).otherwise("*"))
    return labels


def tokenized(labels: DataFrame) -> DataFrame:
    """Labels with their tokens, digits masked in shape, and the tree's first levels."""
    out = labels.withColumn("tokens", F.regexp_extract_all(F.coalesce("label", F.lit("")), F.lit(_WORD), F.lit(1)))
    out = out.withColumn("shape", F.transform("tokens", lambda t: F.when(t.rlike("^[0-9]+$"), "9").otherwise(F.lower(t))))
    return out.withColumn("size", F.size("tokens")).withColumn("first", F.coalesce(F.get("shape", F.lit(0)), F.lit(""))).withColumn("last", F.coalesce(F.get("shape", F.col("size") - 1), F.lit("")))


def layouts(labels: DataFrame) -> DataFrame:
    """(size, first, last, names, number): for each leaf of the tree the positions that hold a speaker's name, and that of a number.

    labels: (label, n, tokens, shape, size, first, last, names_of_talk array, speakers_of_talk int) once per talk and label.
    """
    slots = labels.select("size", "first", "last", "n", "name_words", "speakers_of_talk", F.posexplode("shape").alias("pos", "shape"), "tokens")
    slots = slots.withColumn("token", F.get("tokens", "pos")).withColumn("bare", _bare(F.col("token")))
    hit = F.array_contains("name_words", F.col("bare")) | (F.length("token") == 1) & F.exists("name_words", lambda w: w.startswith(F.col("bare")))
    fits = F.col("token").try_cast("bigint").between(1, F.col("speakers_of_talk"))
    # counts per token first: a layout that most lines share is then a few rows per position
    per = slots.groupBy("size", "first", "last", "pos", "shape").agg(F.sum("n").alias("n"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("name"), F.sum(F.when(fits, F.col("n")).otherwise(0)).alias("fits"))
    at = per.groupBy("size", "first", "last", "pos").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("name").alias("name"), F.max_by("shape", "n").alias("shape"), F.sum("fits").alias("fits"))
    number = (F.col("shape") == "9") & (F.col("most") >= 0.9 * F.col("n")) & (F.col("fits") >= 0.6 * F.col("n"))
    name = ~number & (F.col("name") >= 0.3 * F.col("n"))
    return at.groupBy("size", "first", "last").agg(F.array_sort(F.collect_list(F.when(name, F.col("pos")))).alias("name_at"), F.min(F.when(number, F.col("pos"))).alias("number_at"))  # a row per leaf, as many positions as tokens


def clock_layouts(rows: DataFrame) -> DataFrame:
    """(clock_shape, unit): how the digit groups of each shape of start_time are to be read, by their agreement with start_seconds."""
    part = F.regexp_extract_all("start_time", F.lit("([0-9]+)"), F.lit(1))
    hms, ms = _hms(part), _ms(part)
    agree = rows.where("start_time IS NOT NULL").groupBy("clock_shape").agg(
        F.count_if(F.col("start_seconds").isNotNull() & hms.isNotNull()).alias("n"),
        F.count_if(hms == F.col("start_seconds")).alias("hms"),
        F.count_if(ms == F.col("start_seconds")).alias("ms"),
        F.max(F.size(part)).alias("groups"),
    )
    unit = F.when((F.col("groups") >= 3) & (F.col("hms") * 2 >= F.col("n")), "hms").when((F.col("groups") >= 2) & (F.col("ms") > 0) & (F.col("ms") * 2 >= F.col("n")), "ms")
    return agree.select("clock_shape", unit.alias("unit")).where("unit IS NOT NULL")


def _hms(part: Column) -> Column:
    n = [F.get(part, F.lit(i)).cast("int") for i in range(3)]
    return F.when((n[1] < 60) & (n[2] < 60), n[0] * 3600 + n[1] * 60 + n[2])


def _ms(part: Column) -> Column:
    n = [F.get(part, F.lit(i)).cast("int") for i in range(2)]
    return F.when(n[1] < 60, n[0] * 60 + n[1])


# --- speakers ------------------------------------------------------------------------------------------------------


def fold(name: str) -> str:
    out = unicodedata.normalize("NFD", name.lower())
    return " ".join(re.findall(r"[^\W\d_]+", "".join(c for c in out if not unicodedata.combining(c))))


def apart(a: str, b: str, most: int) -> int:
    """Edits between two strings, neighbours swapped counting one; most + 1 if more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            now.append(cost)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return last[-1]


@lru_cache(1000)
def _forms(people: tuple[tuple[str, str], ...]) -> list[tuple]:
    """(id, words of the name, its forms and their letters) of each of a talk's people."""
    out = []
    for person, name in people:
        own = name.split()
        given, family = " ".join(own[:-1]), own[-1] if own else ""
        out.append((person, own, [(w, frozenset(w)) for w in {name, f"{family} {given}".strip()} if w]))
    return out


def who(label: str, people: Sequence[tuple[str, str]], strict: bool = False) -> str | None:
    """The id of the one person that a label can stand for; people: (id, folded name). strict: only for whole names."""
    words = label.split()
    if not words:
        return None
    forms, letters = _forms(tuple(people)), frozenset(label)
    for sure in (0, 1, 2):  # whole names, then as misspelt, then initial and family name or the family name
        if sure == 2 and strict:
            break
        fits = []
        for i, (_, own, ways) in enumerate(forms):
            if sure == 0 and any(f" {w} " in f" {label} " for w, _ in ways):
                fits.append((0, i))
            elif sure == 1 and len(label) > 6:
                # two edits change no more than four letters of a set
                d = min((apart(label, w, 2) for w, held in ways if abs(len(w) - len(label)) <= 2 and len(held ^ letters) <= 4), default=3)
                if d <= 2:
                    fits.append((d, i))
            elif sure == 2 and own:
                d = apart(words[-1], own[-1], 1) if len(own[-1]) > 4 else int(words[-1] != own[-1])
                if len(words) >= 2 and len(words[-2]) == 1:
                    if words[-2] == own[0][0] and d <= 1:
                        fits.append((d, i))
                elif len(words) == 1 and d <= 1:
                    fits.append((d + 1, i))
                elif len(words) == 1 and words[0] == own[0]:
                    fits.append((1, i))
        if fits:
            fits.sort()
            if len(fits) == 1 or fits[0][0] < fits[1][0]:
                return forms[fits[0][1]][0]
            return None
    return None


def _resolve(label: Column, slots: Column, number: Column, head: Column, people: Column) -> Column:
    """struct(by_label, by_head): speaker ids for the words in a label's slots, its number or a whole name anywhere in it, and for a name
    that heads the text."""

    @F.pandas_udf(T.StructType([T.StructField("by_label", T.StringType()), T.StructField("by_head", T.StringType())]))
    def run(label: pd.Series, slots: pd.Series, number: pd.Series, head: pd.Series, people: pd.Series) -> pd.DataFrame:
        known: dict[str, tuple[tuple, dict, dict]] = {}
        out = []
        for whole, words, no, start, listed in zip(label, slots, number, head, people):
            if listed is None:
                out.append((None, None))
                continue
            if listed not in known:
                rows = [x.split("\x1f") for x in listed.split("\x1e")]
                known[listed] = tuple((r[1], fold(r[2])) for r in rows), {r[0]: r[1] for r in rows}, {}
            persons, numbered, seen = known[listed]
            a = b = None
            if no == no and no is not None:
                a = numbered.get(str(int(no)))
            if a is None and whole:
                if whole not in seen:
                    seen[whole] = (who(fold(words), persons) if words else None) or who(fold(whole), persons, strict=True)
                a = seen[whole]
            if start:
                b = who(fold(start), persons, strict=True)
            out.append((a, b))
        return pd.DataFrame(out, columns=["by_label", "by_head"])

    return run(label, slots, number, head, people)


def _headed(text: Column) -> Column:
    """The part of a text that a name heading it makes up, empty if there is none; only texts with a colon are looked at."""
    return F.when(F.contains(text, F.lit(":")) | F.contains(text, F.lit("：")), F.regexp_extract(text, _HEAD, 0)).otherwise("")


def spoken_rows(utterances: DataFrame, speakers: DataFrame, words: bool = True) -> DataFrame:
    """(talk_id, source_line, second, speaker_id or null, words): the spoken utterances, each once, with what their label or head says.

    Labels and heads are resolved once per talk in which they stand. Without words that column is null.
    """
    text, heading = F.col("text"), F.col("_heading")
    rows = utterances.where(F.col("talk_id").isNotNull() & F.col("source_line").isNotNull() & is_spoken(text))
    rows = rows.select("talk_id", "source_line", F.col("source_label").alias("label"), "start_seconds", "start_time", "text", _headed(text).alias("_heading"))
    rows = rows.select(
        "talk_id",
        "source_line",
        "label",
        "start_seconds",
        "start_time",
        F.regexp_replace("start_time", "[0-9]", "9").alias("clock_shape"),
        F.when(heading != "", F.regexp_extract(heading, _HEAD, 1)).alias("head"),
        F.when(heading != "", is_spoken(F.substring(text, F.length(heading) + 1, F.length(text)))).otherwise(True).alias("spoken_after_head"),
        (spoken_words(text) if words else F.lit(None).cast("string")).alias("words"),
    )
    rows = cut(rows.dropDuplicates(["talk_id", "source_line"]))
    clocks = clock_layouts(rows)
    person = F.concat_ws("\x1f", F.col("speaker_no").cast("string"), "speaker_id", "display_name")
    own = speakers.where("talk_id IS NOT NULL AND speaker_id IS NOT NULL AND display_name IS NOT NULL AND speaker_no IS NOT NULL").select("talk_id", person.alias("person"), "display_name").distinct()
    # a talk's people, not its lines: a list that grows with no table
    people = own.groupBy("talk_id").agg(F.array_join(F.array_sort(F.collect_list("person")), "\x1e").alias("people"), F.array_distinct(F.flatten(F.collect_list(F.split(_bare(F.col("display_name")), r"\s+")))).alias("name_words"), F.count(F.lit(1)).cast("int").alias("speakers_of_talk"))
    names = rows.where("label IS NOT NULL OR head IS NOT NULL").groupBy("talk_id", "label", "head").agg(F.count(F.lit(1)).alias("n"))
    names = cut(tokenized(names.join(people, "talk_id")))
    names = _climbed(names)
    names = names.join(layouts(names), ["size", "first", "last"], "left")
    at_slots = F.array_join(F.transform("name_at", lambda i: F.get("tokens", i)), " ")
    number = F.when(F.size("name_at") == 0, F.get("tokens", F.col("number_at")).try_cast("bigint"))
    found = _resolve(F.col("label"), F.when(F.size("name_at") > 0, at_slots), number, F.col("head"), F.col("people"))
    # null labels and heads are no keys of a join, so they stand as what no label holds
    none = F.lit("\x1d")
    keys = "talk_id", F.coalesce("label", none).alias("_label"), F.coalesce("head", none).alias("_head")
    names = names.select(*keys, found.alias("_found"))  # no filter, which would be resolved for by itself
    rows = rows.select("*", *keys[1:]).join(names, ["talk_id", "_label", "_head"], "left").join(clocks, "clock_shape", "left")
    part = F.regexp_extract_all("start_time", F.lit("([0-9]+)"), F.lit(1))
    clock = F.when(F.col("unit") == "hms", _hms(part)).when(F.col("unit") == "ms", _ms(part))
    rows = rows.withColumn("second", F.coalesce(clock, F.col("start_seconds"), F.lit(0)))
    rows = rows.where(F.col("spoken_after_head") | F.col("_found.by_head").isNull())
    said = F.when(F.col("_found.by_head").isNotNull(), F.trim(F.regexp_replace("words", _HEAD, ""))).otherwise(F.col("words"))
    return rows.select("talk_id", "source_line", "second", F.coalesce("_found.by_label", "_found.by_head").alias("speaker_id"), said.alias("words"))


def _in_blocks(spoken: DataFrame) -> DataFrame:
    """spoken rows with their block of the talk, who speaks as far as the block tells, and the number k of the run of one speaker in it."""
    rows = spoken.withColumn("_block", F.floor(F.col("second") / BLOCK_SECONDS))
    inner = W.partitionBy("talk_id", "_block").orderBy("second", "source_line")
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_who", F.last("speaker_id", ignorenulls=True).over(upto)).withColumn("_before", F.lag("_who").over(inner)).withColumn("_at", F.row_number().over(inner))
    fresh = (F.col("_at") > 1) & ~F.col("_who").eqNullSafe(F.col("_before"))
    return rows.withColumn("_k", F.sum(fresh.cast("int")).over(upto))


def _numbered(runs: DataFrame) -> DataFrame:
    """runs (talk_id, _block, _k, _who, ..) of all blocks with speaker_id, carried on from the blocks before, and the turn's number in its talk.

    What crosses the borders of blocks goes through tables with a row per block.
    """
    ends = runs.groupBy("talk_id", "_block").agg(F.max_by("_who", F.when(F.col("_who").isNotNull(), F.col("_k"))).alias("_end"))
    before = W.partitionBy("talk_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("talk_id", "_block", F.last("_end", ignorenulls=True).over(before).alias("_carry"), (F.count(F.lit(1)).over(before) == 0).alias("_opens"))
    runs = runs.join(ends, ["talk_id", "_block"]).withColumn("speaker_id", F.coalesce("_who", "_carry"))
    prior = F.lag("speaker_id", 1).over(W.partitionBy("talk_id", "_block").orderBy("_k"))
    fresh = F.when(F.col("_k") == 0, F.col("_opens") | ~F.col("speaker_id").eqNullSafe(F.col("_carry"))).otherwise(~F.col("speaker_id").eqNullSafe(prior))
    runs = prefix_sum(runs.withColumn("_fresh", fresh.cast("int")), ["talk_id"], "_block", ["_k"], F.col("_fresh"), "_turn")
    return runs.withColumn("turn", F.col("_turn") + F.col("_fresh")).drop("_turn", "_fresh", "_who", "_carry", "_opens")


def merged(spoken: DataFrame) -> DataFrame:
    """spoken rows with their speaker carried on from the spoken row before, and the turn's number in its talk."""
    rows = cut(_in_blocks(spoken))
    turn = _numbered(rows.groupBy("talk_id", "_block", "_k").agg(F.max("_who").alias("_who"))).select("talk_id", "_block", "_k", "speaker_id", "turn")
    return rows.drop("speaker_id").join(turn, ["talk_id", "_block", "_k"]).select("talk_id", "source_line", "second", "speaker_id", "words", "turn")


def _turns(spoken: DataFrame, words: bool) -> DataFrame:
    """Every talk's turns: runs within blocks first, which are few, then those of neighbouring blocks put together."""
    place = F.struct("second", "source_line")

    def said(*order: str) -> list[Column]:
        return [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "words"))), lambda x: x["words"]), " ").alias("words")] if words else []

    runs = _in_blocks(spoken).groupBy("talk_id", "_block", "_k").agg(F.max("_who").alias("_who"), F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("utterances"), *said("second", "source_line"))
    runs = _numbered(cut(runs))
    out = runs.groupBy("talk_id", "turn").agg(F.max("speaker_id").alias("speaker_id"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("utterances").alias("utterances"), *said("first"))
    return out.select("talk_id", "turn", "speaker_id", F.col("first.second").alias("start_second"), F.col("first.source_line").alias("first_source_line"), F.col("last.source_line").alias("last_source_line"), "utterances", *([F.col("words").alias("text")] if words else []))


def turns(utterances: DataFrame, speakers: DataFrame) -> DataFrame:
    """(talk_id, turn, speaker_id, start_second, first_source_line, last_source_line, utterances, text): every talk's turns in order.

    Lines without a talk or a number are left out; a line with neither clock nor seconds stands at second 0; spoken lines before
    the first known speaker make a turn of a null speaker; empty tables give no turns.
    """
    return _turns(spoken_rows(utterances, speakers), True)


def turn_bounds(utterances: DataFrame, speakers: DataFrame) -> DataFrame:
    """(talk_id, first_source_line, last_source_line, speaker_id) of every turn, without its words."""
    return _turns(spoken_rows(utterances, speakers, words=False), False).select("talk_id", "first_source_line", "last_source_line", "speaker_id")
