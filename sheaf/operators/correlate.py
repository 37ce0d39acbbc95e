"""Which notes an incoming item belongs to: channels of evidence, summed, ranked and judged.

Cards are (note, title, stem, codes, people, tags, text); items (item, title, body, codes, participants).  Every channel gives
(item, note, channel, points, reason).  Channels join on keys; only the phrase channel tests containment, and there a word
inside of the phrase brings phrase and item together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import text as T

CODE, SOFT, RECORD, RECORD_MOST, PHRASE, PHRASE_MOST, TOKENS_MOST, PERSON, PERSON_MOST, TAG = 40, 28, 35, 45, 35, 40, 25, 20, 25, 10
ANCHORED, CORRELATED, GAP, ANCHOR_SIGNAL, EVIDENCE, BODY = 70, 40, 15, 30, 5, 2000
#: Bytes of names, at most, that each executor gets whole.
SENT = 8 << 20
RESULT = ("item", "note", "channel", "points", "reason")


def postings(df: DataFrame, key: str, values: Column, name: str = "key") -> DataFrame:
    return df.select(key, F.explode(values).alias(name)).where(f"{name} is not null and {name} <> ''").distinct()


def budget(rows: DataFrame, each: int, most: int, longest: bool = False) -> DataFrame:
    """``points`` of equal weight in the order of the reasons (with ``longest`` the longest first), as far as the channel's budget
    for a note goes."""
    order = [F.desc(F.length("reason")), F.col("reason")] if longest else ["reason"]
    n = F.row_number().over(Window.partitionBy("item", "note").orderBy(*order))
    return rows.withColumn("points", F.greatest(F.lit(0), F.least(F.lit(each), F.lit(most) - F.lit(each) * (n - 1))).cast("int"))


def idf(cards: DataFrame) -> DataFrame:
    """(key, df, idf) of the tokens of titles; idf = ln(notes / df), to nine digits."""
    p = postings(cards, "note", T.tokens(F.col("title")))
    n = cards.agg(F.count("*").alias("n_notes"))
    return p.groupBy("key").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("key", "df", F.round(F.log(F.col("n_notes") / F.col("df")), 9).cast("decimal(18,9)").alias("idf"))


def tokens(items: DataFrame, cards: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Shared tokens by their rarity; of given ``pairs`` (item, note) alone, where other evidence is needed anyway: then no token
    brings pairs together, however many notes have it."""
    weights = idf(cards)
    top = weights.agg(F.max("idf").cast("double").alias("m")).select(F.when(F.coalesce("m", F.lit(0.0)) > 0, F.col("m")).otherwise(1.0).alias("top"))
    titled, body = T.tokens(F.col("title")), F.substring("body", 1, BODY)
    if pairs is None:
        shared = postings(items, "item", F.array_union(T.tokens(F.col("title")), T.tokens(body))).join(weights.where("idf > 0"), "key").join(postings(cards, "note", titled), "key")
    else:
        # What an item says moves last, once for an item and not once for a pair; what is no token meets none of a title.
        said = items.select("item", F.array_distinct(F.concat(T.said(F.col("title")), T.said(body))).alias("said"))
        both = pairs.select("item", "note").distinct().join(cards.select("note", titled.alias("titled")), "note").join(said, "item")
        shared = both.select("item", "note", F.explode(F.array_intersect("titled", "said")).alias("key")).join(weights.where("idf > 0"), "key")
    raw = shared.groupBy("item", "note").agg(F.sum("idf").cast("double").alias("raw"), F.count("*").alias("n"))
    scored = raw.crossJoin(F.broadcast(top)).withColumn("points", F.least(F.lit(TOKENS_MOST), F.bround(25 * F.col("raw") / (F.col("top") * 2.5))).cast("int"))
    return scored.where("points >= 3").select("item", "note", F.lit("tokens").alias("channel"), "points", F.col("n").cast("string").alias("reason"))


def codes(items: DataFrame, cards: DataFrame) -> DataFrame:
    i, c = (postings(d, k, F.transform("codes", lambda x: T.code_key(x))) for d, k in ((items, "item"), (cards, "note")))
    return i.join(c, "key").select("item", "note", F.lit("code").alias("channel"), F.lit(CODE).alias("points"), F.col("key").alias("reason"))


def soft_codes(items: DataFrame, cards: DataFrame) -> DataFrame:
    """Codes that a note's title or name has without declaring them."""
    i = postings(items, "item", F.transform("codes", lambda x: T.code_key(x)))
    grams = postings(cards, "note", F.array_union(T.code_ngrams(F.col("title")), T.code_ngrams(F.col("stem"))))
    declared = postings(cards, "note", F.transform("codes", lambda x: T.code_key(x)))
    return i.join(grams, "key").join(declared, ["note", "key"], "left_anti").select("item", "note", F.lit("soft-code").alias("channel"), F.lit(SOFT).alias("points"), F.col("key").alias("reason"))


def inherited(items: DataFrame, cards: DataFrame, climb: DataFrame) -> DataFrame:
    """Codes of the ancestors (id, ancestor, depth) of an item's codes, worth half as much at each level."""
    i = postings(items, "item", F.col("codes"), "id").join(climb, "id")
    c = postings(cards, "note", F.transform("codes", lambda x: T.code_key(x)))
    j = i.join(c, F.upper(i["ancestor"]) == c["key"])
    return j.groupBy("item", "note", "key").agg(F.max(F.greatest(F.lit(1), F.floor(F.lit(CODE) / F.pow(F.lit(2), F.col("depth"))))).cast("int").alias("points")).select("item", "note", F.lit("inherited").alias("channel"), "points", F.col("key").alias("reason"))


def records(items: DataFrame, cards: DataFrame, pattern: str) -> DataFrame:
    """Numbers minted elsewhere, known by their shape."""
    i, c = postings(items, "item", T.matches(F.concat_ws("\n", "title", "body"), pattern)), postings(cards, "note", T.matches(F.col("text"), pattern))
    rows = i.join(c, "key").select("item", "note", F.lit("record").alias("channel"), F.col("key").alias("reason"))
    return budget(rows, RECORD, RECORD_MOST).select(*RESULT)


def people(items: DataFrame, cards: DataFrame) -> DataFrame:
    def parts(c: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(c, lambda x: T.name_parts(x))))

    rows = postings(items, "item", parts("participants")).join(postings(cards, "note", parts("people")), "key").select("item", "note", F.lit("person").alias("channel"), F.col("key").alias("reason"))
    return budget(rows, PERSON, PERSON_MOST).select(*RESULT)


_CUT = r"[^\p{L}\p{N}_]+"


def _texts(items: DataFrame) -> DataFrame:
    return items.select("item", F.lower(F.concat_ws("\n", "title", "body")).alias("hay"))


def _met(hay: DataFrame, wanted: DataFrame, holds: Column) -> DataFrame:
    """(item, name) where ``holds`` is true of the text (hay) and the name, among those that meet: a text has the word that a name (name,
    word) can't do without; names without such a word meet every text.  Names of up to SENT bytes are sent to the texts, which
    then don't move; where there are more, the words of the texts go to the names, and a text to each name that it meets."""
    distinct = wanted.select("name", "word").distinct()
    few = distinct.agg(F.coalesce(F.sum(F.octet_length("name") + F.coalesce(F.octet_length("word"), F.lit(0)) + 64), F.lit(0))).head()[0] <= SENT
    sent = F.broadcast if few else lambda d: d
    with_word, plain = sent(distinct.where("word is not null")), sent(distinct.where("word is null").select("name"))
    words = hay.select("item", "hay", F.explode(F.array_distinct(F.split("hay", _CUT))).alias("word"))
    by_word = words.join(with_word, "word") if few else words.select("item", "word").join(with_word, "word").select("item", "name").distinct().join(hay, "item")
    return by_word.where(holds).select("item", "name").unionByName(hay.crossJoin(plain).where(holds).select("item", "name"))


def tags(items: DataFrame, cards: DataFrame) -> DataFrame:
    """Tags of more than three characters that the item's text has between word boundaries.  A tag's first word must be one of
    the text, where these meet."""
    t = postings(cards, "note", F.transform("tags", lambda x: F.lower(x)), "name").where("length(name) > 3")
    words = F.filter(F.split("name", _CUT), lambda x: x != "")
    pattern = F.concat(F.lit(r"(?U)\b\Q"), F.replace("name", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    met = _met(_texts(items), t.select("name", F.get(words, F.lit(0)).alias("word")), F.rlike("hay", pattern))
    return met.join(t, "name").select("item", "note", F.lit("tag").alias("channel"), F.lit(TAG).alias("points"), F.col("name").alias("reason"))


def phrases(items: DataFrame, cards: DataFrame) -> DataFrame:
    """Titles and aliases (a column that cards may have) of six characters or more that the item's text contains; one within a longer
    one of the same note that it also contains doesn't count, and the longest come first in the budget.  A phrase's longest word
    that isn't at its ends must be a word of the text: those meet in a join on words.  Phrases of less than three words have no
    such word, and meet the texts one by one."""
    names = F.array("title") if "aliases" not in cards.columns else F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    p = postings(cards, "note", F.transform(names, lambda x: F.lower(F.btrim(x))), "name").where("length(name) >= 6")
    words = F.split("name", _CUT)
    inner = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda x: x != "")
    wanted = p.select("name", F.get(F.array_sort(F.transform(inner, lambda x: F.struct((-F.length(x)).alias("l"), x.alias("w")))), F.lit(0))["w"].alias("word"))
    met = _met(_texts(items), wanted, F.contains("hay", "name")).join(p, "name")
    # The names of a note are few: each is held against the others of its note.
    each = met.groupBy("item", "note").agg(F.collect_set("name").alias("all")).select("item", "note", "all", F.explode("all").alias("reason"))
    kept = each.where(~F.exists("all", lambda x: (x != F.col("reason")) & F.contains(x, F.col("reason")))).select("item", "note", F.lit("phrase").alias("channel"), "reason")
    return budget(kept, PHRASE, PHRASE_MOST, longest=True).select(*RESULT)


def ranked(evidence: DataFrame, k: int = 5) -> DataFrame:
    """(item, note, score, best, evidence, rank): the ``k`` notes of the greatest sums, by note where equal.  Scores end at 100; a first
    place that no single strong signal supports is held under the anchoring score, and its evidence says so."""
    why = F.array_sort(F.collect_set(F.concat_ws(":", "channel", "reason")))
    s = evidence.groupBy("item", "note").agg(F.sum("points").alias("total"), F.max("points").alias("best"), why.alias("why"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("total"), "note"))
    s = s.withColumn("rank", rank).where(F.col("rank") <= k)
    held = (F.col("rank") == 1) & (F.col("total") >= ANCHORED) & (F.col("best") < ANCHOR_SIGNAL)
    score = F.when(held, ANCHORED - 1).otherwise(F.least(F.lit(100), "total")).cast("int")
    shown = F.when(held, F.concat(F.slice("why", 1, EVIDENCE - 1), F.array(F.lit(f"capped: no single signal >= {ANCHOR_SIGNAL}")))).otherwise(F.slice("why", 1, EVIDENCE))
    return s.select("item", "note", score.alias("score"), "best", F.array_join(shown, ",").alias("evidence"), "rank")


def related(cards: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of notes of one subject: they share a code or a tag, one links to the other's name, or they are in the same
    top folder.  Cards have (note, stem, codes, tags, links, folder) for it; what is missing or null says nothing."""
    none = F.array().cast("array<string>")
    arr = lambda c: (F.coalesce(c, none) if c in cards.columns else none).alias(c)
    one = lambda c: (F.col(c) if c in cards.columns else F.lit(None).cast("string")).alias(c)
    c = cards.select("note", F.transform(arr("codes"), lambda x: T.code_key(x)).alias("codes"), F.transform(arr("tags"), lambda x: F.lower(x)).alias("tags"), F.transform(arr("links"), lambda x: F.lower(x)).alias("links"), F.lower(one("stem")).alias("stem"), F.split_part(one("folder"), F.lit("/"), F.lit(1)).alias("folder"))
    side = lambda s: c.select(*[F.col(x).alias(s if x == "note" else f"{s}_{x}") for x in c.columns])
    j = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    same = F.arrays_overlap("a_codes", "b_codes") | F.arrays_overlap("a_tags", "b_tags") | F.coalesce(F.array_contains("a_links", F.col("b_stem")), F.lit(False)) | F.coalesce(F.array_contains("b_links", F.col("a_stem")), F.lit(False)) | F.coalesce(F.col("a_folder") == F.col("b_folder"), F.lit(False))
    return j.where(same).select("a", "b")


def states(items: DataFrame, top: DataFrame, related: DataFrame) -> DataFrame:
    """(item, note, score, state) of every item.  A first place that no single strong signal supports is held under the
    anchoring score and called weak; a close second one that isn't ``related`` (a, b) makes it ambiguous."""
    first = top.where("rank = 1").select("item", "note", "score", "best")
    second = top.where("rank = 2").select("item", F.col("note").alias("note2"), F.col("score").alias("score2"))
    kin = related.select(F.least("a", "b").alias("ka"), F.greatest("a", "b").alias("kb"), F.lit(True).alias("kin")).distinct()
    j = items.select("item", (F.size("codes") > 0).alias("coded")).join(first, "item", "left").join(second, "item", "left")
    j = j.join(kin, (F.least("note", "note2") == F.col("ka")) & (F.greatest("note", "note2") == F.col("kb")), "left")
    score = F.coalesce("score", F.lit(0))
    state = (
        F.when((score >= CORRELATED) & (F.col("best") < ANCHOR_SIGNAL), "weak")
        .when((score >= CORRELATED) & F.col("score2").isNotNull() & (score - F.col("score2") <= GAP) & F.col("kin").isNull(), "ambiguous")
        .when(score >= ANCHORED, "anchored")
        .when(score >= CORRELATED, "correlated")
        .when(F.col("coded"), "topic-known")
        .otherwise("new")
    )
    return j.select("item", "note", score.cast("int").alias("score"), state.alias("state"))


def gaps(evidence: DataFrame, linked: DataFrame, floor: int = 40, k: int = 5) -> DataFrame:
    """(item, note, score, rank): notes that score at least ``floor`` for a note, without a link (a, b) either way.  They are sought
    among the first max(4 k, 20), of which the note itself is one if there is evidence for it."""
    both = linked.select("a", "b").unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    s = evidence.groupBy("item", "note").agg(F.sum("points").cast("int").alias("score")).where(F.col("score") >= floor)
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "note"))).where(F.col("rank") <= max(4 * k, 20))
    s = s.where("item <> note").join(both, (s["item"] == both["a"]) & (s["note"] == both["b"]), "left_anti").drop("rank")
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "note"))).where(F.col("rank") <= k)
    return s.withColumn("score", F.least(F.lit(100), "score"))
