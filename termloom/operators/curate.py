"""Relations between candidates and curated terms: places, aliases, hierarchy, differences, sparse merges.

A curated term is a row (term, definition, parent, aliases, see_also, children, locations); locations
hold (file, main, context). Input order is kept in a column ``ord`` where first-of-equals matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.text import ascii_fold, compact_candidate, compact_entry, fold, path_ends_with

LOCATIONS = "array<struct<file string, main boolean, context string>>"
STRINGS = "array<string>"
TERM_COLUMNS = ["term", "definition", "parent", "aliases", "see_also", "children", "locations"]


def strings(x: Column | str) -> Column:
    """An array of strings, empty for null."""
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.array().cast(STRINGS))


def surface_forms(terms: DataFrame) -> DataFrame:
    """Columns term, form_ord, form: the term itself, then its aliases, in lower case."""
    return terms.select("term", F.posexplode(F.transform(F.concat(F.array("term"), strings("aliases")), F.lower)).alias("form_ord", "form"))


def candidate_places(candidates: DataFrame) -> DataFrame:
    """Columns form, name, loc_ord, file, context. Of candidates with one key the last wins, by ``ord`` if there."""
    rows = candidates.withColumn("form", fold("term"))
    if "ord" in candidates.columns:
        last = Window.partitionBy("form").orderBy(F.desc("ord"))
        rows = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return rows.select("form", F.col("term").alias("name"), F.posexplode_outer("locations").alias("loc_ord", "at")).select("form", "name", "loc_ord", "at.file", "at.context")


def curated_locations(terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """Columns term, pos, file, context: the places of a term's candidates, the first per file."""
    hits = surface_forms(terms).join(candidate_places(candidates).where("file is not null"), "form")
    firsts = hits.groupBy("term", "file").agg(F.min(F.struct("form_ord", "loc_ord", "context")).alias("best"))
    order = Window.partitionBy("term").orderBy("best.form_ord", "best.loc_ord")
    return firsts.select("term", F.row_number().over(order).alias("pos"), "file", F.col("best.context").alias("context"))


def main_flags(places: DataFrame, terms: DataFrame) -> DataFrame:
    """Add ``main``: the file ends with one of the term's main files, component by component."""
    rows = places.join(terms.select("term", strings("main_files").alias("_mains")), "term")
    return rows.withColumn("main", F.exists("_mains", lambda m: path_ends_with("file", m))).drop("_mains")


def gather_locations(places: DataFrame) -> DataFrame:
    """A row per term: locations, in order of pos."""
    packed = F.array_sort(F.collect_list(F.struct("pos", "file", "main", "context")))
    return places.groupBy("term").agg(F.transform(packed, lambda x: F.struct(x["file"].alias("file"), x["main"].alias("main"), x["context"].alias("context"))).alias("locations"))


def added_aliases(terms: DataFrame, candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Columns term, aliases: the given ones, then names of candidates met, then variants of known terms.

    ``known``: known_ord, term, variants. A known term applies where it is the term or one of the aliases
    as they stand after the first step. Names are compared in lower case; the first spelling stays.
    """
    own = terms.select("term", F.posexplode(strings("aliases")).alias("a", "alias")).select("term", F.lit(0).alias("step"), F.col("a").cast("long").alias("o"), F.lit(0).cast("long").alias("p"), "alias")
    met = surface_forms(terms).join(candidate_places(candidates).select("form", "name").distinct(), "form")
    met = met.where(fold("name") != fold("term")).select("term", F.lit(1).alias("step"), F.col("form_ord").cast("long").alias("o"), F.lit(0).cast("long").alias("p"), F.col("name").alias("alias"))
    first = own.unionByName(met)
    names = first.select("term", fold("alias").alias("form")).unionByName(terms.select("term", fold("term").alias("form"))).distinct()
    variants = known.select(fold("term").alias("form"), F.col("known_ord").cast("long").alias("o"), F.posexplode(strings("variants")).alias("v", "alias"))
    more = names.join(variants, "form").select("term", F.lit(2).alias("step"), "o", F.col("v").cast("long").alias("p"), "alias")
    every = first.unionByName(more)
    # given aliases all stay; an added one only if no alias of that name came before
    ranked = every.withColumn("n", F.row_number().over(Window.partitionBy("term", fold("alias")).orderBy("step", "o", "p")))
    kept = ranked.where("step = 0 or n = 1")
    packed = kept.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "o", "p", "alias"))), lambda x: x["alias"]).alias("found"))
    return terms.select("term").join(packed, "term", "left").select("term", strings("found").alias("aliases"))


def children(terms: DataFrame) -> DataFrame:
    """``terms`` with children: the terms whose parent this one is (exact case), sorted by bytes."""
    below = terms.where("parent is not null").groupBy(F.col("parent").alias("_of")).agg(F.array_sort(F.collect_list("term")).alias("_children"))
    return terms.drop("children").join(below, F.col("term") == F.col("_of"), "left").withColumn("children", strings("_children")).drop("_of", "_children")


def dangling(terms: DataFrame) -> DataFrame:
    """Terms whose parent isn't a term."""
    names = terms.select(F.col("term").alias("_name")).distinct()
    return terms.where("parent is not null").join(names, F.col("parent") == F.col("_name"), "left_anti")


def drop_dangling_parents(terms: DataFrame) -> DataFrame:
    names = terms.select(F.col("term").alias("_name")).distinct()
    joined = terms.join(names, F.col("parent") == F.col("_name"), "left")
    return joined.withColumn("parent", F.when(F.col("_name").isNotNull(), F.col("parent"))).drop("_name")


def alphabetical(terms: DataFrame, max_terms: int | None) -> DataFrame:
    """In order of lower-case terms, cut after ``max_terms`` (None: not at all); late letters go, not low scores."""
    sorted_ = terms.orderBy(fold("term"), "term")
    return sorted_ if max_terms is None else sorted_.limit(max_terms)


def suggested_rows(suggested: DataFrame) -> DataFrame:
    none = F.array().cast(STRINGS)
    return suggested.select("term", "definition", "parent", none.alias("aliases"), none.alias("see_also"), F.array().cast(LOCATIONS).alias("locations"))


def post_process(terms: DataFrame, suggested: DataFrame, candidates: DataFrame, known: DataFrame, max_terms: int | None = 200) -> DataFrame:
    """A model's full output as curated terms: places, aliases, suggested terms, children, alphabetical cut."""
    found = gather_locations(main_flags(curated_locations(terms, candidates), terms))
    base = terms.select("term", "definition", "parent", strings("see_also").alias("see_also"))
    made = base.join(added_aliases(terms, candidates, known), "term").join(found, "term", "left")
    made = made.withColumn("locations", F.coalesce("locations", F.array().cast(LOCATIONS)))
    every = made.unionByName(suggested_rows(suggested))
    return alphabetical(children(every), max_terms).select(*TERM_COLUMNS)


def new_candidates(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """Candidates that no term or alias names."""
    return candidates.join(surface_forms(terms).select("form").distinct(), fold(candidates["term"]) == F.col("form"), "left_anti")


def new_counts(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: new (candidates that no term or alias names), total."""
    named = candidates.join(surface_forms(terms).select("form").distinct(), fold(candidates["term"]) == F.col("form"), "left")
    return named.agg(F.count_if(F.col("form").isNull()).alias("new"), F.count(F.lit(1)).alias("total"))


def stale_terms(terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """Terms with places none of whose forms is a candidate any more."""
    placed = terms.where(F.size("locations") > 0)
    alive = surface_forms(placed).join(candidates.select(fold("term").alias("form")).distinct(), "form", "left_semi").select("term").distinct()
    return placed.join(alive, "term", "left_anti")


def new_ratio(new: Column | str, total: Column | str) -> Column:
    new, total = (F.col(x) if isinstance(x, str) else x for x in (new, total))
    return F.when(total == 0, F.lit(0.0)).otherwise(new / total)


def ratio_warning(ratio: Column | str) -> Column:
    ratio = F.col(ratio) if isinstance(ratio, str) else ratio
    return F.when(ratio >= 0.7, "full rebuild advised").when(ratio >= 0.4, "many new candidates")


def merge_delta(terms: DataFrame, additions: DataFrame, modifications: DataFrame, removals: DataFrame, suggested: DataFrame) -> DataFrame:
    """Removals, then patches, then additions and suggestions.

    Names of removals match in lower case, those of patches in the lower case of A-Z alone. A patch's nulls
    change nothing, so a parent can't be cleared; of several patches of a term each column's last value counts
    (by ``ord``). A patch goes to the first term of its name (by ``ord``, else by its spelling); one without a
    term is skipped. Added rows have no places until they are mapped.
    """
    left = terms.join(removals.select(fold("term").alias("_gone")).distinct(), fold(terms["term"]) == F.col("_gone"), "left_anti")
    fields = ["definition", "parent", "aliases", "see_also"]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"_{c}") for c in fields]
    patches = modifications.groupBy(ascii_fold("term").alias("_name")).agg(*last)
    first = "ord" if "ord" in terms.columns else "term"
    numbered = left.withColumn("_n", F.row_number().over(Window.partitionBy(ascii_fold("term")).orderBy(first)))
    patched = numbered.join(patches, (ascii_fold("term") == F.col("_name")) & (F.col("_n") == 1), "left")
    for c in fields:
        patched = patched.withColumn(c, F.coalesce(f"_{c}", c))
    patched = patched.select("term", *fields, "locations")
    added = additions.select("term", "definition", "parent", strings("aliases").alias("aliases"), strings("see_also").alias("see_also")).withColumn("locations", F.array().cast(LOCATIONS))
    return patched.unionByName(added).unionByName(suggested_rows(suggested))


def merge_log(terms: DataFrame, additions: DataFrame, modifications: DataFrame, removals: DataFrame, suggested: DataFrame) -> DataFrame:
    """One row: removed, modified, added, suggested."""
    gone = removals.select(fold("term").alias("_k")).distinct()
    removed = terms.join(gone, fold(terms["term"]) == F.col("_k"), "left_semi").agg(F.count(F.lit(1)).alias("n"))
    left = terms.join(gone, fold(terms["term"]) == F.col("_k"), "left_anti").select(ascii_fold("term").alias("_l")).distinct()
    modified = modifications.join(left, ascii_fold(modifications["term"]) == F.col("_l"), "left_semi").agg(F.count(F.lit(1)).alias("n"))
    rows = None
    for name, df in (("removed", removed), ("modified", modified), ("added", additions.agg(F.count(F.lit(1)).alias("n"))), ("suggested", suggested.agg(F.count(F.lit(1)).alias("n")))):
        row = df.select(F.lit(name).alias("what"), "n")
        rows = row if rows is None else rows.unionByName(row)
    return rows.groupBy().pivot("what", ["removed", "modified", "added", "suggested"]).agg(F.first("n"))


def remap_locations(terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """``terms`` with fresh places; ``main`` stays where the term's old place in that file had it."""
    old = terms.select("term", F.explode("locations").alias("at")).select("term", F.col("at.file").alias("file"), F.col("at.main").alias("_main"))
    old = old.groupBy("term", "file").agg(F.max("_main").alias("_main"))
    fresh = curated_locations(terms, candidates).join(old, ["term", "file"], "left").withColumn("main", F.coalesce("_main", F.lit(False)))
    found = gather_locations(fresh)
    return terms.drop("locations").join(found, "term", "left").withColumn("locations", F.coalesce("locations", F.array().cast(LOCATIONS)))


def incremental(terms: DataFrame, candidates: DataFrame, delta: dict[str, DataFrame] | None, max_terms: int | None = 200) -> DataFrame:
    """Merge a delta (if there is one), map places anew, rebuild children, drop dangling parents, cut."""
    merged = merge_delta(terms, delta["additions"], delta["modifications"], delta["removals"], delta["suggested"]) if delta else terms
    return alphabetical(children(drop_dangling_parents(remap_locations(merged, candidates))), max_terms).select(*TERM_COLUMNS)


def compact_index(terms: DataFrame) -> DataFrame:
    return terms.select("term", compact_entry("term", "parent", strings("children"), strings("aliases"), strings("see_also")).alias("line"))


def compact_candidates(candidates: DataFrame) -> DataFrame:
    files = F.transform("locations", lambda x: x["file"])
    return candidates.select("term", compact_candidate("term", "score", files).alias("line"))
