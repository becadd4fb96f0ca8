"""Names of known things in texts: the phrase index, linking, and passages as the search index holds them.

The index has one row per phrase, with what it means already decided. Texts meet it in two steps: their distinct words
meet the first words of phrases, which tells what lengths are worth looking at where, and only those few
candidate phrases meet the index. Both are equi-joins on any number of phrases; a passage's hits are folded in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep import rules
from lorekeep.functions import text
from lorekeep.session import staged


def _tokens(phrase: Column) -> Column:
    return F.split(phrase, " ")


def phrase_index(entities: DataFrame, aliases: DataFrame, refers_to: DataFrame) -> DataFrame:
    """(phrase, n, entity): normal phrases of up to LONGEST_PHRASE words and the one thing each means; entity null where it could be several.

    entities: entity, name, type; aliases: entity, alias, kind; refers_to: term, target. A term that refers to a thing
    lends it its words. Of several things a real one wins over terms, then the one that is called so by a set phrase.
    """
    common = F.array(*map(F.lit, rules.EVERYDAY_WORDS))
    known = entities.where(~F.col("type").isin(rules.UNLINKED_TYPES)).join(refers_to.select(F.col("term").alias("entity"), "target"), "entity", "left")
    known = known.withColumn("target", F.when(F.col("type") == "Term", F.col("target")))
    means, term = F.coalesce("target", "entity"), F.col("type") == "Term"
    row = lambda df, phrase, entity, is_name, is_set, strong: df.select(text.normalize_phrase(phrase).alias("phrase"), entity.alias("entity"), "type", is_name.alias("is_name"), is_set.alias("is_set"), strong.alias("strong"))
    no, yes = F.lit(False), F.lit(True)
    said = aliases.join(known, "entity")
    set_kind = F.col("kind").isin(rules.SET_PHRASE_KINDS)
    named = row(known, F.col("name"), means, F.col("target").isNull(), term, F.col("target").isNotNull())
    also = row(said, F.col("alias"), means, no, term | set_kind, F.col("target").isNotNull() | (set_kind & F.col("target").isNull()))
    # an abbreviation in a name may be written out
    short = F.create_map(*[F.lit(x) for kv in rules.ABBREVIATIONS.items() for x in kv])
    words = _tokens(text.normalize_phrase(F.col("name")))
    spelled = F.transform(words, lambda w: F.coalesce(short[w], w))
    apart = F.filter(F.transform(words, lambda w: short[w]), lambda w: w.isNotNull())
    written = F.when(F.size(apart) > 0, F.concat(F.array(F.array_join(spelled, " ")), F.when(F.size(words) > 1, apart).otherwise(F.array().cast("array<string>"))))
    out = row(known.select("*", F.explode(written).alias("written")), F.col("written"), F.col("entity"), no, no, no)
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace("name", rules.LEGAL_TAIL, "")), r"[,.]\s*$", ""))
    bare = row(known.where(bare != F.col("name")), bare, F.col("entity"), yes, no, no)
    rows = named.union(also).union(out).union(bare).withColumn("n", F.size(_tokens(F.col("phrase"))))
    everyday = F.size(F.array_except(_tokens(F.col("phrase")), common)) == 0
    code = F.col("phrase").rlike(rules.CODE_PHRASE)
    rows = rows.where((F.col("phrase") != "") & (F.col("n") <= rules.LONGEST_PHRASE))
    rows = rows.where((F.col("n") > 1) | code | ((F.length("phrase") >= 3) & ~everyday)).where(~everyday | (F.col("is_set") & (F.col("n") > 1)) | code)
    rows = rows.where((F.col("type") != "Asset") | ~F.col("is_name") | code)
    types = known.select("entity", (F.col("type") != "Term").alias("real"))
    held = rows.groupBy("phrase", "n", "entity").agg(F.bool_or("strong").alias("strong")).join(types, "entity", "left")
    real = F.coalesce("real", F.lit(True))
    only = lambda of: F.when(F.count_if(of) == 1, F.min(F.when(of, F.col("entity"))))
    decided = held.groupBy("phrase", "n").agg(F.coalesce(only(yes), only(real), only(real & F.col("strong"))).alias("entity"))
    # a first word that one thing's name alone begins with, and that is in no other phrase or name
    first, whole = words[0], text.normalize_phrase(F.col("name"))
    person = F.col("type").isin(rules.PEOPLE_TYPES)
    inner = entities.select(F.explode(F.slice(words, 2, 1 << 20)).alias("phrase")).distinct()
    begins = known.where(person | F.col("type").isin(rules.ORGANISATION_TYPES)).where((first != whole) & ~F.array_contains(common, first) & ~first.rlike("[0-9]"))
    begins = begins.where(F.length(first) >= F.when(person, 3).otherwise(5)).select(first.alias("phrase"), person.alias("person"), "entity")
    alone = begins.groupBy("phrase", "person").agg(F.count_distinct("entity").alias("of"), F.min("entity").alias("entity")).where("of = 1")
    alone = alone.groupBy("phrase").agg(F.max_by("entity", "person").alias("entity")).join(inner, "phrase", "left_anti").join(decided, "phrase", "left_anti")
    linked = decided.union(alone.select("phrase", F.lit(1).alias("n"), "entity"))
    return linked.join(types.select("entity", F.lit(True).alias("there")), "entity", "left").select("phrase", "n", F.when(F.col("there"), F.col("entity")).alias("entity"))


def link_phrases(passages: DataFrame, keys: list[str], column: str, phrases: DataFrame) -> DataFrame:
    """(keys, entity_ids): what each passage mentions, in order of first mention; the longest phrase at a place wins and takes its words.

    Passages without a mention have no row. A passage's words and hits are folded in one row, so passages must be of bounded length.
    Each word takes those that a phrase could hold after it along, so no passage is cut twice and none is shuffled for its words.
    """
    index = staged(phrases.select("phrase", F.col("n").alias("_size"), F.col("entity").alias("_entity")), "phrases")
    heads = index.groupBy(F.split_part("phrase", F.lit(" "), F.lit(1)).alias("_word")).agg(F.collect_set("_size").alias("_lengths"))  # at most LONGEST_PHRASE
    heads = staged(heads, "heads")
    split = passages.select(*keys, F.filter(_tokens(text.normalize_phrase(F.col(column))), lambda w: w != "").alias("_words"))
    at = split.select(*keys, "_words", F.posexplode_outer("_words").alias("_at", "_word"))  # an inner one is preceded by a filter that splits each passage once more
    at = at.select(*keys, "_at", "_word", F.slice("_words", F.col("_at") + 1, rules.LONGEST_PHRASE).alias("_next")).join(heads, "_word")
    asked = at.select(*keys, "_at", "_next", F.explode("_lengths").alias("_n")).where(F.col("_n") <= F.size("_next"))
    asked = asked.select(*keys, "_at", F.array_join(F.slice("_next", F.lit(1), F.col("_n")), " ").alias("_phrase"))
    met = asked.join(index.withColumnRenamed("phrase", "_phrase"), "_phrase")
    longest_first = F.struct(F.col("_at").alias("at"), (-F.col("_size")).alias("less"), F.col("_size").alias("n"), F.col("_entity").alias("entity"))
    rows = met.groupBy(*keys).agg(F.sort_array(F.collect_list(longest_first)).alias("_hits"))
    none = F.array().cast("array<string>")

    def step(acc: Column, hit: Column) -> Column:
        new = hit["entity"].isNotNull() & ~F.array_contains(acc["ids"], F.coalesce(hit["entity"], F.lit("")))
        ids = F.when(new, F.array_append(acc["ids"], hit["entity"])).otherwise(acc["ids"])
        return F.when(hit["at"] >= acc["end"], F.struct((hit["at"] + hit["n"]).alias("end"), ids.alias("ids"))).otherwise(acc)

    found = F.aggregate("_hits", F.struct(F.lit(0).alias("end"), none.alias("ids")), step, lambda acc: acc["ids"])
    return rows.select(*keys, found.alias("entity_ids")).where(F.size("entity_ids") > 0)


def twin_lists(files: DataFrame) -> DataFrame:
    """(file, lists): the access lists of all copies of each file (file, digest, acl) that has any; as many as there are lists."""
    of_digest = files.where("digest is not null").groupBy("digest").agg(F.array_sort(F.collect_set("acl")).alias("lists"), F.count("*").alias("copies"))
    return files.join(of_digest.where("copies > 1"), "digest").select("file", "lists")


def newer_versions(files: DataFrame) -> DataFrame:
    """(file, replaced_by): newer versions in the file's family (file, path, digest), copies of the file itself left out.

    One file of each distinct content stands for its copies, so a family is as long as it has versions.
    """
    named = files.select("file", "digest", text.family_key(F.col("path")).alias("family"), text.revision(F.col("path")).cast("int").alias("revision")).where("family <> ''")
    versions = named.groupBy("family", "revision", "digest").agg(F.min("file").alias("file"))
    of_family = versions.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("revision", "digest", "file"))).alias("versions")).where("size(versions) > 1")
    later = F.filter("versions", lambda v: (v["revision"] > F.col("revision")) & (v["digest"] != F.col("digest")))
    found = named.join(of_family, "family").select("file", F.transform(later, lambda v: v["file"]).alias("replaced_by"))
    return found.where(F.size("replaced_by") > 0)


def project_passages(passages: DataFrame, files: DataFrame, facts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Passages (file, n, title, content) as the index holds them: entity_ids, facts, replaced_by, is_current, acl_ids.

    files: file, path, digest, acl, labelled (a marked file keeps its own readers only); facts: file, fact.
    """
    said = passages.withColumn("said", F.concat_ws("\n", "title", "content"))
    mentions = link_phrases(said, ["file", "n"], "said", phrases)
    stated = facts.groupBy("file").agg(F.array_sort(F.collect_set("fact")).alias("facts"))
    twins = twin_lists(files)
    lists = F.when(F.col("labelled") | F.col("lists").isNull(), F.array("acl")).otherwise(F.array_sort(F.array_union(F.array("acl"), F.col("lists"))))
    access = files.join(twins, "file", "left").select("file", F.filter(lists, lambda a: a.isNotNull()).alias("acl_ids"))
    none = F.array().cast("array<string>")
    out = passages.join(mentions, ["file", "n"], "left").join(access, "file").join(stated, "file", "left").join(newer_versions(files), "file", "left")
    newer = F.transform(F.coalesce("replaced_by", F.array().cast("array<long>")), lambda f: f.cast("string"))
    filled = [F.coalesce(c, none).alias(c) for c in ("entity_ids", "facts")]
    return out.select("file", "n", *filled, newer.alias("replaced_by"), F.col("replaced_by").isNull().alias("is_current"), "acl_ids")
