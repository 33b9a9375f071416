"""Entity resolution: mentions against a catalogue by identifier, by exact name, then by similar name.

Catalogue: id, canonical_name, entity_type, identifiers MAP, aliases ARRAY. Mentions: id,
name, entity_type, identifiers MAP. Mentions are resolved as a set, not one after another;
mentions that found the same new entity share its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from factloom.functions.names import SCHEMES, display_name, entity_type, identifier, identifier_conflicts, name_key, scheme_key, short_hash
from factloom.sources.stored import stored

MERGE, REVIEW, MARGIN = 97.0, 88.0, 4.0
#: Letters left out of a name at most to find its like; a name of 25 letters has 300 such rests.
FEW = 2


def one_each(entries):
    """A map of sorted (key, value) entries; of several values of a key the least stays."""
    schemes = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(schemes, F.transform(schemes, lambda k: F.get(F.filter(entries, lambda e: e["key"] == k), F.lit(0))["value"]))


def prepare(mentions: DataFrame) -> DataFrame:
    """Clean names, keys and identifiers; a DIN makes a person, a CIN a company."""
    entries = F.transform(F.map_entries(F.map_filter("identifiers", lambda k, v: F.trim(v) != "")), lambda e: F.struct(scheme_key(e["key"]).alias("key"), identifier(scheme_key(e["key"]), e["value"]).alias("value")))
    ids = one_each(F.array_sort(entries))
    df = mentions.withColumn("identifiers", F.coalesce(ids, F.create_map().cast("map<string,string>"))).withColumn("name", display_name(F.col("name")))
    has = lambda k: F.map_contains_key("identifiers", k)
    return df.withColumns({"entity_type": F.when(has("din"), "person").when(has("cin"), "company").otherwise(entity_type(F.col("entity_type"))), "key": name_key(F.col("name"))})


def entity_id(ids, name_key_, kind):
    """By the first identifier in order of priority, else by name and type."""
    named = F.coalesce(*(F.when(F.try_element_at(ids, F.lit(s)).isNotNull(), F.concat(F.lit(f"{s}:"), F.try_element_at(ids, F.lit(s)))) for s in SCHEMES))
    return F.coalesce(named, short_hash("entity_", name_key_, kind))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each place of a."""
    same = 0  # common ends belong to a longest one
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    a, b = a[same:], b[same:]
    while a and b and a[-1] == b[-1]:
        a, b, same = a[:-1], b[:-1], same + 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    ones = (1 << len(a)) - 1
    s = ones
    for c in b:
        u = s & places.get(c, 0)
        s = (s + u | s - u) & ones
    return same + len(a) - s.bit_count()


def similarity(a: str, b: str) -> float:
    """Indel similarity in percent, of the texts or of their sorted tokens, whichever is more."""
    ratio = lambda x, y: 200 * _lcs(x, y) / (len(x) + len(y)) if x or y else 100.0
    left, right = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return ratio(a, b) if (left, right) == (a, b) else max(ratio(a, b), ratio(left, right))


@pandas_udf(DoubleType())
def name_score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _sorted_tokens(key):
    return F.array_join(F.array_sort(F.split(key, " ")), " ")


def _without(texts, times: int):
    """The distinct texts that are left when so many letters of each are left out."""
    for _ in range(times):
        texts = F.array_distinct(F.flatten(F.transform(texts, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substr(t, i + 1, F.length(t)))))))
    return texts


def _plan(keys: DataFrame, ckeys: DataFrame) -> DataFrame:
    """Pairs of lengths (n, c) that allow a score of REVIEW, with the most letters outside the common subsequence: drop of n and of c, both together spare."""
    pairs = keys.select(F.length("key").alias("n")).distinct().crossJoin(ckeys.select(F.length("key").alias("c")).distinct())
    both, gap = F.col("n") + F.col("c"), F.col("n") - F.col("c")
    most = F.floor((100 - REVIEW) * both / 100).cast("int")
    pairs = pairs.withColumn("spare", most - (most + both) % 2).where(F.col("spare") >= F.abs(gap))
    return pairs.withColumns({"drop_n": ((F.col("spare") + gap) / 2).cast("int"), "drop_c": ((F.col("spare") - gap) / 2).cast("int")}).withColumn("few", F.greatest("drop_n", "drop_c") <= FEW)


def _left(names: DataFrame, drop: str):
    """A row for each way to leave out ``drop`` letters of a text: a signature of the rest and the catalogue name's length."""
    rest = F.when(F.col(drop) == 0, F.array("text"))
    for k in range(1, FEW + 1):
        rest = rest.when(F.col(drop) == k, _without(F.array("text"), k))
    return names.select("h", "c", F.explode(rest).alias("rest")).select("h", F.xxhash64(F.lit(-1), "c", "rest").alias("sig"))


def near_keys(keys: DataFrame, ckeys: DataFrame) -> DataFrame:
    """(key, ckey, score) of all pairs of name keys with a score of REVIEW or more.

    A score bounds the letters outside the common subsequence. Where at most FEW of either name
    are, both names, less these letters, are one text: a join on that text finds hardly another
    pair. Else the catalogue's name is cut into one more part than there may be such letters.
    For the first part j up to whose end there are no more than j of them, that part has none and those
    before it exactly j, so it is found in the mention j letters further, less two for each letter left out.
    """
    tasks = 4 * keys.sparkSession.sparkContext.defaultParallelism  # a short name has many rests
    plan = F.broadcast(_plan(keys, ckeys))
    named = lambda df: df.select(F.xxhash64("key").alias("h"), F.length("key").alias("len"), F.explode(F.array_distinct(F.array(F.col("key"), _sorted_tokens(F.col("key"))))).alias("text")).repartition(tasks)
    m = named(keys).join(plan, F.col("len") == F.col("n"))
    known = named(ckeys)
    wide = plan.where("not few").groupBy("c").agg(F.max("spare").alias("most"))
    c_few = known.join(F.broadcast(plan.where("few").select("c", "drop_c").distinct()), F.col("len") == F.col("c"))
    c_cut = known.join(F.broadcast(wide), F.col("len") == F.col("c"))
    start = lambda j: F.floor(j * F.col("c") / (F.col("most") + 1)).cast("int")
    sig = lambda j, part: F.xxhash64(F.col("c"), j, part)
    parts = c_cut.select("h", "c", "most", "text", F.explode(F.sequence(F.lit(0), "most")).alias("j")).select("h", sig(F.col("j"), F.substr("text", start(F.col("j")) + 1, start(F.col("j") + 1) - start(F.col("j")))).alias("sig"))
    m_cut = m.where("not few").join(F.broadcast(wide), "c").withColumn("j", F.explode(F.sequence(F.lit(0), "spare")))
    m_cut = m_cut.withColumn("at", start(F.col("j"))).withColumn("size", start(F.col("j") + 1) - F.col("at"))
    m_cut = m_cut.withColumn("gone", F.explode(F.sequence(F.lit(0), F.col("j")))).withColumn("at", F.col("at") + F.col("j") - 2 * F.col("gone"))
    m_cut = m_cut.where("gone <= drop_c and j - gone <= drop_n and at >= 0 and at + size <= n").select("h", sig(F.col("j"), F.substr("text", F.col("at") + 1, F.col("size"))).alias("sig"))
    mine, theirs = _left(m.where("few"), "drop_n").unionByName(m_cut), _left(c_few, "drop_c").unionByName(parts)
    pairs = mine.join(theirs.withColumnRenamed("h", "hc"), "sig").select("h", "hc").distinct()
    texts = lambda df, h, name: df.select(F.xxhash64("key").alias(h), F.col("key").alias(name))
    found = stored(pairs.join(texts(keys, "h", "key"), "h").join(texts(ckeys, "hc", "ckey"), "hc").select("key", "ckey"), "near")
    return found.select("key", "ckey", name_score("key", "ckey").alias("score")).where(F.col("score") >= REVIEW)


def resolve(mentions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """A row for each mention: id, entity_id, method (identifier, exact_name, fuzzy_name, needs_review, conflict, new_entity), confidence, candidates."""
    m = prepare(mentions)
    names = F.array_distinct(F.transform(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("canonical_name")), lambda n: name_key(n)))
    c = catalogue.select(F.col("id").alias("entity"), F.col("entity_type").alias("type"), F.col("identifiers").alias("ids"), names.alias("keys"))
    compatible = (F.col("entity_type") == F.col("type")) | (F.col("entity_type") == "unknown") | (F.col("type") == "unknown")
    by_id = m.select("id", "entity_type", "identifiers", F.explode("identifiers").alias("s", "v")).join(c.select("entity", "type", "ids", F.explode("ids").alias("s", "v")), ["s", "v"]).groupBy("id").agg(
        F.array_sort(F.collect_set("entity")).alias("found"), F.max((F.size(identifier_conflicts(F.col("identifiers"), F.col("ids"))) > 0) | ~compatible).alias("clash"))
    names_c = c.select("entity", "type", "ids", F.explode("keys").alias("ckey"))
    by_name = m.join(names_c, (F.col("key") == F.col("ckey")) & compatible).groupBy("id").agg(F.array_sort(F.collect_set("entity")).alias("found"), F.max(F.size(identifier_conflicts(F.col("identifiers"), F.col("ids"))) > 0).alias("clash"))
    open_ = m.join(by_id.select("id"), "id", "left_anti").join(by_name.select("id"), "id", "left_anti").where(F.length("key") >= 5)
    near = near_keys(stored(open_.select("key").distinct(), "names"), stored(names_c.select(F.col("ckey").alias("key")).distinct(), "names"))
    scored = open_.join(near, "key").join(names_c, "ckey").where(compatible)
    per = scored.groupBy("id", "entity").agg(F.max("score").alias("score"), F.max(F.size(identifier_conflicts(F.col("identifiers"), F.col("ids"))) > 0).alias("clash"))
    by_score = per.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("score", "entity")), False).alias("s"), F.max("clash").alias("clash")).select("id", F.transform("s", lambda x: x["entity"]).alias("found"), "clash", F.col("s")[0]["score"].alias("best"), F.coalesce(F.get("s", F.lit(1))["score"], F.lit(0.0)).alias("second"))
    j = m.join(by_id.toDF("id", "f1", "c1"), "id", "left").join(by_name.toDF("id", "f2", "c2"), "id", "left").join(by_score.toDF("id", "f3", "c3", "best", "second"), "id", "left")
    method = (
        F.when(F.size("f1") > 1, "conflict").when(F.col("c1"), "conflict").when(F.col("f1").isNotNull(), "identifier")
        .when(F.col("c2"), "conflict").when(F.size("f2") > 1, "needs_review").when(F.col("f2").isNotNull(), "exact_name")
        .when(F.col("c3"), "conflict").when((F.col("best") >= MERGE) & (F.col("best") - F.col("second") >= MARGIN), "fuzzy_name").when(F.col("best").isNotNull(), "needs_review").otherwise("new_entity")
    )
    found = F.coalesce("f1", "f2", "f3", F.array().cast("array<string>"))
    own = F.when(method.isin("conflict", "needs_review"), short_hash("entity-review:", F.col("key"), F.col("entity_type"), F.to_json("identifiers"))).when(method == "new_entity", entity_id(F.col("identifiers"), F.col("key"), F.col("entity_type"))).otherwise(found[0])
    sure = F.when(method == "identifier", 0.99).when(method == "exact_name", 0.96).when(method == "fuzzy_name", F.least(F.lit(0.95), F.col("best") / 100)).when(method == "new_entity", 0.9).otherwise(0.6)
    return j.select("id", "name", "entity_type", "identifiers", own.alias("entity_id"), method.alias("method"), sure.alias("confidence"), F.when(method.isin("new_entity"), F.array().cast("array<string>")).otherwise(found).alias("candidates"))


def merged(catalogue: DataFrame, resolved: DataFrame) -> DataFrame:
    """The catalogue with new entities, learned aliases and identifiers.

    Of several values of one scheme the least stays; mentions that clash with the catalogue were resolved to a review entity before.
    """
    known = catalogue.select("id", F.lit(0).alias("ord"), F.col("canonical_name").alias("name"), "entity_type", "identifiers", F.lit(1.0).alias("confidence"), "aliases")
    seen = resolved.select(F.col("entity_id").alias("id"), F.lit(1).alias("ord"), "name", "entity_type", "identifiers", "confidence", F.array().cast("array<string>").alias("aliases"))
    both = known.unionByName(seen)
    return both.groupBy("id").agg(
        F.min_by("name", F.struct("ord", "name")).alias("canonical_name"), F.min_by("entity_type", F.struct("ord", "name")).alias("entity_type"),
        F.array_distinct(F.array_sort(F.flatten(F.collect_list(F.map_entries("identifiers"))))).alias("entries"),
        F.array_sort(F.array_distinct(F.concat(F.collect_set("name"), F.flatten(F.collect_list("aliases"))))).alias("aliases"), F.min("confidence").alias("confidence"),
    ).select("id", "canonical_name", "entity_type", one_each(F.col("entries")).alias("identifiers"), "aliases", "confidence")


def resolve_facts(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Facts under their entities; doubt about the entity reaches the fact."""
    r = resolved.select(F.col("id").alias("subject_id"), "entity_id", "method", F.col("confidence").alias("sure"))
    j = facts.join(r, "subject_id", "left")
    out = {"subject_id": F.coalesce("entity_id", "subject_id"), "extraction_confidence": F.least("extraction_confidence", F.coalesce("sure", F.lit(1.0))), "review_state": F.when(F.col("method").isin("conflict", "needs_review"), "needs_review").otherwise(F.col("review_state"))}
    return j.withColumns(out).select(*facts.columns)
