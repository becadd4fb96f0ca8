"""Reports over facts and results: sections, supporting passages, histories per reader, rates of searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep import rules
from lorekeep.operators.graph import top_per_group


def _in_sections(facts: DataFrame, key: str, sections: dict[str, tuple[Column, int]]) -> DataFrame:
    """(key, section, n, fact_id): each fact in every section that takes it, in the order of `at`, as many as the section holds."""
    taken = F.array_compact(F.array(*[F.when(fits, F.struct(F.lit(name).alias("section"), F.lit(most).alias("most"))) for name, (fits, most) in sections.items()]))
    rows = facts.select(key, "at", "fact_id", F.explode(taken).alias("s")).select(key, "at", "fact_id", "s.*")
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy(key, "section").orderBy("at", "fact_id")))
    return ranked.where("n <= most").select(key, "section", "n", "fact_id")


def procedure(facts: DataFrame) -> DataFrame:
    """(topic, section, n, fact_id): the rules, practice, exceptions and outdated versions of each topic; a topic without rules and practice has a gap.

    facts: topic, at (place in the search), fact_id, kind, value, current, outdated_by. A null `current` counts as outdated.
    """
    current, most = F.coalesce("current", F.lit(False)), rules.PROCEDURE_LIMITS
    rule, practice = current & ((F.col("kind") == "policy") | F.col("value").rlike(rules.RULE_WORDS)), current & (F.col("kind") == "practice")
    held = {"rules": rule, "practice": practice, "exceptions": current & (F.col("kind") == "exception"), "outdated": ~current | F.col("outdated_by").isNotNull()}
    told = F.max(F.coalesce(rule | practice, F.lit(False)))
    gaps = facts.groupBy("topic").agg(told.alias("told")).where("not told").select("topic", F.lit("gap"), F.lit(1), F.lit(None).cast("long"))
    return _in_sections(facts, "topic", {name: (fits, most[name]) for name, fits in held.items()}).union(gaps)


def training_plan(facts: DataFrame) -> DataFrame:
    """(role, section, n, fact_id): current facts of each role's four searches, by the kinds that the section takes.

    facts: role, search (name of the section), at, fact_id, kind, current.
    """
    fits = lambda name, kinds: F.col("current") & (F.col("search") == name) & F.col("kind").isin(kinds)
    return _in_sections(facts, "role", {name: (fits(name, kinds), most) for name, (kinds, most) in rules.TRAINING_SECTIONS.items()})


def telling_words(c: Column) -> Column:
    """The distinct words that tell a fact apart: three signs and more, no stop words."""
    found = F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9$%.]{3,}"), F.lit(0)), lambda w: F.regexp_replace(w, r"\.$", ""))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(rules.FACT_STOP_WORDS)))


def supporting_passages(facts: DataFrame, passages: DataFrame, least: float = 0.3, most: int = 6) -> DataFrame:
    """(fact_id, passage_id, shared, score): the passages of a fact's evidence that hold the largest share of its words.

    facts: fact_id, content (two lines count); passages: fact_id, passage_id, content. Both meet by fact and word, so that
    no fact gathers its passages in one task before they are ranked.
    """
    asked = facts.select("fact_id", telling_words(F.array_join(F.slice(F.split("content", "\n"), 1, 2), " ")).alias("w"))
    asked = asked.select("fact_id", F.size("w").alias("size"), F.explode("w").alias("word"))
    held = passages.select("fact_id", "passage_id", F.explode(telling_words(F.col("content"))).alias("word"))
    shared = held.join(asked, ["fact_id", "word"]).groupBy("fact_id", "passage_id").agg(F.count("*").alias("shared"), F.first("size").alias("size"))
    scored = shared.withColumn("score", F.col("shared") / F.col("size")).where(F.col("score") >= least)
    return top_per_group(scored, ["fact_id"], [F.desc("score"), F.col("passage_id")], most).select("fact_id", "passage_id", "shared", "score")


def history_cards(steps: DataFrame) -> DataFrame:
    """(topic, acl, content, classes): the history of each topic as each class of readers sees it, one card per distinct content.

    steps: topic, subject, fact_id, valid_from, valid_to, value, status, acl (null: everyone). Undated steps don't count; fewer
    than two visible steps are no history. The card of the smallest acl stands for all classes with the same content.
    """
    dated = steps.where("valid_from is not null or valid_to is not null")
    day = lambda c, none: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(none))
    line = F.concat(day("valid_from", "…"), F.lit(" → "), day("valid_to", "now"), F.lit(" · "), "subject", F.lit(": "), "value", F.when(F.col("status") == "superseded", " (replaced)").otherwise(""))
    own = dated.select("topic", "subject", "fact_id", "valid_from", line.alias("line"), "acl")
    classes = own.where("acl is not null").select("topic", "acl").distinct()
    seen = own.where("acl is not null").unionByName(own.where("acl is null").drop("acl").join(classes, "topic"))
    cards = seen.groupBy("topic", "acl").agg(F.count_distinct("subject").alias("subjects"), F.sort_array(F.collect_list(F.struct("valid_from", "fact_id", "line"))).alias("s")).where("size(s) >= 2")
    content = F.concat(F.lit("history across "), F.col("subjects").cast("string"), F.lit(" records:\n"), F.array_join(F.transform("s", lambda x: x["line"]), "\n"))
    return cards.select("topic", "acl", content.alias("content")).groupBy("topic", "content").agg(F.min("acl").alias("acl"), F.count("*").alias("classes"))


def outdated_first(hits: DataFrame) -> DataFrame:
    """(category, judged, worse): questions with a current or outdated hit, and those whose first outdated one stands above all current ones."""
    first = lambda state: F.min(F.when(F.col("state") == state, F.col("rank")))
    asked = hits.groupBy("category", "q").agg(first("current").alias("new"), first("outdated").alias("old")).where("new is not null or old is not null")
    return asked.groupBy("category").agg(F.count("*").alias("judged"), F.count_if(F.expr("old is not null and (new is null or old < new)")).alias("worse"))


def robustness(hits: DataFrame) -> DataFrame:
    """(style, outcome, n): how each phrasing ends: found in the first ten, ranked low, dropped, too deep, or never found.

    hits: style, q, leg ("final" of 50, "keyword" and "meaning" of 100), rank, gold.
    """
    best = lambda legs, most: F.min(F.when(F.col("leg").isin(legs) & F.col("gold") & (F.col("rank") <= most), F.col("rank")))
    asked = hits.groupBy("style", "q").agg(best(["final"], 50).alias("final"), best(["keyword", "meaning"], 100).alias("leg"))
    outcome = F.when(F.col("final") <= 10, "found").when(F.col("final").isNotNull(), "ranked low").when(F.col("leg") <= 30, "dropped").when(F.col("leg").isNotNull(), "found too deep").otherwise("never found")
    return asked.groupBy("style", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def context_pack(questions: DataFrame, hits: DataFrame, named: DataFrame, facts: DataFrame, today: str, sources: int = 12, excerpt: int = 900, things: int = 3, current: int = 25, earlier: int = 15) -> DataFrame:
    """(query_id, part, n, line): what an answer may rest on, for all questions in one job, each thing and fact once.

    questions: query_id; hits: query_id, rank, doc_type, title, place, is_current, disputed, content; named: query_id, nth, entity, name, type;
    facts: entity, fact, since, until, disputed. Parts: source (the best hits, numbered, with their standing and an excerpt), change (what their
    timelines say, each line once), current and earlier (facts of the first `things` named things that aren't terms: those in force,
    the newest first, and those that ended before today, the last first). A thing that several questions name is looked up once.
    """
    asked = questions.select("query_id").distinct()
    best = hits.join(asked, "query_id", "left_semi").where(F.col("rank") <= sources)
    standing = F.when(F.col("doc_type") != "fact", "Supports").when(F.col("disputed"), "Disputed").when(F.col("is_current"), "Current").otherwise("Outdated")
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), "title", F.lit(" · "), "place", F.lit(" ("), standing, F.lit(")\n"), F.substring("content", 1, excerpt))
    source = best.select("query_id", F.lit("source").alias("part"), F.col("rank").cast("long").alias("n"), line.alias("line"))
    told = F.get(F.filter(F.split("content", "\n"), lambda x: x.startswith("Timeline: ")), F.lit(0))
    changes = best.select("query_id", "rank", F.concat("title", F.lit(": "), F.substring(told, 11, 1 << 20)).alias("line")).where("line is not null").groupBy("query_id", "line").agg(F.min("rank").cast("long").alias("n"))
    change = changes.select("query_id", F.lit("change").alias("part"), "n", "line")

    of_question = Window.partitionBy("query_id").orderBy("nth", "entity")
    meant = named.join(asked, "query_id", "left_semi").where("type <> 'Term'").withColumn("nth", F.row_number().over(of_question)).where(F.col("nth") <= things)
    wanted = facts.join(meant.select("entity").distinct(), "entity", "left_semi").distinct()
    over = F.col("until") < F.lit(today).cast("date")
    day = lambda c: F.date_format(c, "MMM d, yyyy")
    newest = Window.partitionBy("entity").orderBy(F.col("since").desc_nulls_last(), "fact")
    last = Window.partitionBy("entity").orderBy(F.desc("until"), "fact")
    force = wanted.where(over.isNull() | ~over).withColumn("k", F.row_number().over(newest)).where(F.col("k") <= current)
    ended = wanted.where(over).withColumn("k", F.row_number().over(last)).where(F.col("k") <= earlier)
    now = F.concat("fact", F.when(F.col("since").isNotNull(), F.concat(F.lit(" (since "), day("since"), F.lit(")"))).otherwise(""), F.when(F.col("disputed"), " [DISPUTED]").otherwise(""))
    before = F.concat("fact", F.lit(" ("), F.when(F.col("since").isNotNull(), F.concat(day("since"), F.lit(" to "))).otherwise("until "), day("until"), F.lit(")"))
    lines = force.select("entity", F.lit("current").alias("part"), "k", now.alias("line")).union(ended.select("entity", F.lit("earlier"), "k", before))
    stated = meant.join(lines, "entity").select("query_id", "part", (F.col("nth") * 100 + F.col("k")).cast("long").alias("n"), F.concat("name", F.lit(": "), "line").alias("line"))
    return source.union(change).union(stated)


def prompts(pack: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, prompt): a pack as one text per question, parts and lines in order; a pack is of bounded size."""
    order = F.create_map(*[F.lit(x) for kv in {"change": 1, "current": 2, "earlier": 3, "source": 4}.items() for x in kv])
    rows = pack.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(order[F.col("part")].alias("o"), "n", "line"))).alias("lines"))
    whole = F.array_join(F.transform(F.coalesce("lines", F.array()), lambda x: x["line"]), "\n")
    return questions.join(rows, "query_id", "left").select("query_id", F.concat(F.lit("Question: "), "question", F.lit("\n"), whole).alias("prompt"))
