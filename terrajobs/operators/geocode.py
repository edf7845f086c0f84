"""Addresses to coordinates and back, against gazetteer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrajobs.functions import names
from terrajobs.functions.columns import attach, free_names
from terrajobs.functions.geo import finite
from terrajobs.functions.markup import html_to_all_text
from terrajobs.functions.storage import materialize
from terrajobs.functions.text import simple_name
from terrajobs.operators.nearest import nearest_points
from terrajobs.operators.search import search

# Words that stand, with an apostrophe, before a name.
ELIDED = ("dell", "del", "d", "nell", "sull", "sant", "Sant")
#: One of them glued to a capitalised word.
APOSTROPHE = rf"\b({'|'.join(ELIDED)})(\p{{Lu}}\S+)"


def repair_apostrophes(col: Column) -> Column:
    """"dellAquila" as "dell'Aquila": small words glued to a capitalised one."""
    return F.regexp_replace(col, APOSTROPHE, "$1'$2")


def search_text(address: str, comune: str | None = None) -> Column:
    """What is looked up: the address in lower case, with the comune unless the address has it or it is null."""
    text = F.lower(F.col(address))
    if comune is None:
        return text
    there = F.col(comune).isNull() | text.contains(F.lower(F.col(comune)))
    return F.when(there, text).otherwise(F.concat(text, F.lit(", "), F.lower(F.col(comune))))


def verify_location(found: str, value: str, parents: list[str]) -> Column:
    """``value`` where the address found has the lower-cased first of ``parents``, else null. A null parent is a failure; without parents all stay."""
    if not parents:
        return F.col(value)
    return F.when(F.coalesce(F.lower(F.col(found)).contains(F.lower(F.col(parents[0]))), F.lit(False)), F.col(value))


def _abbreviated(failed: DataFrame, search: str) -> DataFrame:
    """``search, key, n_road, n_letters, n_name, any_road`` of addresses that abbreviate next to each other what stands between a road and a name."""
    words = F.split(F.trim(F.split(F.col(search), ",")[0]), " +")
    dotted = F.filter(words, lambda w: w.rlike(r"^(?:\p{Ll}\.)+$"))
    first, last = F.array_position(words, F.get(dotted, F.lit(0))).cast("int"), F.size(words)
    name = F.slice(words, first + F.size(dotted), last)
    # Some words, then the abbreviations next to each other, then the name: all others are not asked for.
    fits = (F.size(dotted) > 0) & (first > 1) & (F.size(name) > 0) & (F.slice(words, first, F.size(dotted)) == dotted)
    road = F.slice(words, F.lit(1), first - 1)
    any_road = F.array_join(road, " ").isin(*names.ROAD_PREFIXES)
    letters = F.filter(F.split(F.array_join(dotted, ""), r"\."), lambda w: w != "")
    asked = failed.select(search).where(F.col(search).isNotNull() & F.coalesce(fits, F.lit(False))).distinct()
    key = _window_key(F.when(any_road, ANY_ROAD).otherwise(F.array_join(road, " ")), F.array_join(letters, ""), F.array_join(name, " "))
    return asked.select(search, key.alias("key"), F.size(road).alias("n_road"), F.size(letters).alias("n_letters"), F.size(name).alias("n_name"), any_road.alias("any_road"))


#: Stands in a key for any of the words for a road.
ANY_ROAD = "*"


def _window_key(road: Column, letters: Column, name: Column) -> Column:
    return F.concat_ws("|", road, letters, name)


def _windows(words: Column, n_road: int, n_letters: int, n_name: int, any_road: bool) -> Column:
    """(key, said) of every place of a text where words could be a road, words that are abbreviated by their letters, and a name."""
    size = n_road + n_letters + n_name
    span = lambda i, skip, n: F.slice(words, i + skip, F.lit(n))

    def fits(i: Column) -> Column:
        spelled = F.forall(span(i, n_road, n_letters), lambda w: w.rlike("^[a-z]{2,}$"))
        return F.element_at(words, i).isin(*names.ROAD_PREFIXES) & spelled if any_road else spelled

    def window(i: Column) -> Column:
        road = F.lit(ANY_ROAD) if any_road else F.array_join(span(i, 0, n_road), " ")
        letters = F.array_join(F.transform(span(i, n_road, n_letters), lambda w: F.substring(w, 1, 1)), "")
        return F.struct(_window_key(road, letters, F.array_join(span(i, n_road + n_letters, n_name), " ")).alias("key"), F.array_join(span(i, 0, size), " ").alias("said"))

    places = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(places, fits), window)


def expand_abbreviations(failed: DataFrame, search: str, pages: DataFrame, html: str | None = "html") -> DataFrame:
    """``search, expanded``: dotted abbreviations ("viale g. p. da palestrina") as pages spell them in full, where
    they do so in one way only.

    Pages give windows of words: a road (any of the usual words for one, or the very words asked for), words of two letters and more whose first
    letters are those abbreviated, and the name. Windows of one key shrink to the least and the greatest spelling where they are read, so
    however often pages say a name, an address meets one row. Which numbers of words are asked for comes to the driver: a row for each.
    """
    asked = materialize(_abbreviated(failed, search), "abbreviated")
    shapes = asked.select("n_road", "n_letters", "n_name", "any_road").distinct().collect()
    if not shapes:
        return asked.select(search, F.col(search).alias("expanded")).limit(0)
    # A page becomes text once: a filter over the text would go below it and do so again.
    texts = materialize(pages.select(html_to_all_text(html).alias("text")), "page-texts") if html else pages.select("text")
    texts = texts.where("text IS NOT NULL").select(F.split("text", " ").alias("words"))
    windows = texts.select(F.explode(F.concat(*(_windows(F.col("words"), *shape) for shape in shapes))).alias("w")).select("w.*")
    spelled = windows.groupBy("key").agg(F.min("said").alias("expanded"), F.max("said").alias("_other")).where("expanded = _other")
    return asked.join(spelled, "key").select(search, "expanded")


def _look_up(asked: DataFrame, text: str, gazetteer: DataFrame) -> DataFrame:
    """``asked`` with lat, lon and found; the first of several entries by address."""
    spots = gazetteer.select(simple_name(F.col("address")).alias("_a"), F.struct("full_address", "latitude", "longitude").alias("_s")).groupBy("_a").agg(F.min("_s").alias("_s"))
    met = asked.join(spots, simple_name(F.col(text)) == F.col("_a"), "left")
    return met.select(*asked.columns, F.col("_s.latitude").alias("lat"), F.col("_s.longitude").alias("lon"), F.col("_s.full_address").alias("found"))


def geocode_addresses(
    df: DataFrame, gazetteer: DataFrame, address: str, *, comune: str | None = None, provincia: str | None = None, regione: str | None = None, pages: DataFrame | None = None, similar: float | None = None
) -> DataFrame:
    """``df``, all rows, with latitude and longitude from a gazetteer (address, full_address, latitude, longitude).

    Each distinct address is looked up once; failures are tried again with apostrophes repaired and, with ``pages``, with
    abbreviations in full. What is then not found is, with ``similar``, searched by its words: the most similar entry counts, if it is so by
    that much (0.7, say), whatever the order of the words, a postcode that the gazetteer does not have, or an abbreviated "via". A
    place counts where its address has the comune given (else the province, else the region).
    """
    parents = [p for p in (comune, provincia, regione) if p is not None]
    given = [address, *parents]
    asked = df.select(*given).distinct().withColumn("_search", search_text(address, comune))
    first = _look_up(asked, "_search", gazetteer)
    failed = F.col("_found1").isNull() & F.col(address).rlike(APOSTROPHE)
    again = first.withColumnsRenamed({"lat": "_lat1", "lon": "_lon1", "found": "_found1"}).withColumn("_again", F.when(failed, repair_apostrophes(F.col(address))))
    second = _look_up(again, "_again", gazetteer)
    both = second.select(*given, "_search", *(F.coalesce(f"_{c}1", c).alias(c) for c in ("lat", "lon", "found")))
    if pages is not None:
        spelled = expand_abbreviations(both.where("found IS NULL"), "_search", pages).withColumnRenamed("_search", "_failed")
        tail = F.regexp_extract("_search", r"^[^,]*(,.*)?$", 1)
        third = both.join(spelled, (F.col("_search") == F.col("_failed")) & F.col("found").isNull(), "left").withColumn("_full", F.concat("expanded", tail))
        third = _look_up(third.withColumnsRenamed({"lat": "_lat1", "lon": "_lon1", "found": "_found1"}), "_full", gazetteer)
        both = third.select(*given, *(F.coalesce(f"_{c}1", c).alias(c) for c in ("lat", "lon", "found")))
    if similar is not None:
        both = materialize(both.withColumn("_asked", F.when(F.col("found").isNull(), search_text(address, comune))), "looked-up")
        spot = F.struct("full_address", "latitude", "longitude")
        near = search(both, "_asked", gazetteer, "address", spot, similar).select(F.col("_asked").alias("_text"), F.col("value").alias("_near"))
        fourth = both.join(near, F.col("_asked") == F.col("_text"), "left")
        both = fourth.select(*given, *(F.coalesce(c, F.col("_near")[of]).alias(c) for c, of in (("lat", "latitude"), ("lon", "longitude"), ("found", "full_address"))))
    named = free_names(["latitude", "longitude"], df.columns)
    values = {named["latitude"]: verify_location("found", "lat", parents), named["longitude"]: verify_location("found", "lon", parents)}
    return attach(df, [F.col(g) for g in given], both, given, values, nulls_meet=True)


def reverse_geocode(df: DataFrame, gazetteer: DataFrame, latitude: str, longitude: str, *, most: float = 0.01, side: float | None = None) -> DataFrame:
    """``df``, all rows, with the address (lower case) and city of the nearest gazetteer entry within ``most`` degrees, else null.

    Names that ``df`` has get ``_geo``, as often as it takes. Each distinct point is looked up once.
    """
    points = df.select(finite(F.col(latitude).cast("double")).alias("_lat"), finite(F.col(longitude).cast("double")).alias("_lon")).where("_lat IS NOT NULL AND _lon IS NOT NULL").distinct()
    points = points.withColumn("_id", F.struct("_lat", "_lon"))
    spots = gazetteer.select(F.struct(F.lower("full_address").alias("address"), "city").alias("spot"), F.col("longitude").alias("tx"), F.col("latitude").alias("ty"))
    near = nearest_points(points, "_id", spots, "spot", 1, side, "_lon", "_lat", most=most).select("_id", "spot")
    found = near.select("_id.*", "spot")
    names_out = free_names(["address", "city"], df.columns, "_geo")
    return attach(df, [F.col(latitude).cast("double"), F.col(longitude).cast("double")], found, ["_lat", "_lon"], {n: F.col("spot")[c] for c, n in names_out.items()})
