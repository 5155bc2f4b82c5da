"""Triage of region candidates: ordered rules over titles give a status, a kind and a confidence."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of titles that are about music's institutions and media, not about a region.
NOISE = (
    "albums", "alumni", "archive", "association football music", "award", "awards", "based on works", "by former country", "by genre and country", "by decade",
    "by year", "charts", "companies", "company", "competition", "competitions", "compositions", "conservatoire", "conservatorium", "documentary films",
    "education", "educators", "events", "festivals", "films", "folk music groups", "houses", "hall of fame", "industries", "industry", "instruments",
    "instrument ensembles", "instrument makers", "journalism", "mass media", "members of", "music association", "music magazine", "music-related lists",
    "musicologists", "musical groups", "musical atlas", "musical museum", "musical theatre", "musicals", "music magazines", "music museum", "music museums",
    "music people", "music videos", "music about", "music commissioned by", "music competitions", "music critics", "music festival", "music festivals",
    "music manuscript sources", "music schools", "music society", "music theatre", "music and politics", "music by former country",
    "music by genre and country", "music censorship", "music mass media", "musicology", "music duos", "music groups", "musicians", "nightclubs", "opera houses",
    "organisations", "organizations", "political music artists", "political music genres", "podcasters", "artists", "patrons of music", "performers",
    "printers", "radio programs", "radio stations", "record labels", "retailers", "symphony orchestra", "television series", "television shows", "theory",
    "school of music", "school of folk music", "song cycle", "songs", "stubs", "venues", "video directors", "websites", "writers about music", "years in",
    "psychological operations", "research association",

)
# More such words, for the last round.
LATE_NOISE = (
    "appreciation month", "ballet school", "camp", "centre for", "college", "collection", "conference", "congress", "conservatory", "library", "lyceum", "medal",
    "medals", "music centre", "music center", "music union", "musical society", "performing arts", "prize", "sculpture", "state music", "university",
)
# Places by kind.
TERRITORIES = (
    "anguilla", "bermuda", "british virgin islands", "cayman islands", "faroe islands", "french guiana", "french polynesia", "greenland", "guadeloupe", "guam",
    "martinique", "mayotte", "montserrat", "new caledonia", "réunion", "reunion", "tokelau", "turks and caicos", "virgin islands",
)
CONTINENTS = ("africa", "asia", "europe", "north america", "south america", "oceania")
PARTS = (
    "caribbean", "latin america", "middle east", "balkans", "caucasus", "southeast asia", "south asia", "west africa", "central africa", "southern africa",
    "east africa", "micronesia", "polynesia", "melanesia",
)
DISTRICTS = ("county", "department", "province", "state", "territory", "region", "metropolitan borough", "republic")
BOX = r"\bby (?:city|country|continent|dependent territory|locality|province|region|state|territory)\b"
STYLE = ("folk music", "traditional music", "indigenous", "diaspora", "ancient", "medieval", "renaissance")
STYLE_SOURCE = ("styles of music", "music genres", "folk music", "traditional music", "indigenous music")
PLAIN_SOURCE = (*STYLE_SOURCE, "music of ", "music in ", "music by region", "music by city")


def holds(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def bare(c) -> Column:
    """A lower-cased title without its category mark."""
    return F.regexp_replace(F.trim(F.lower(F.coalesce(F.col(c), F.lit("")))), "^category:", "")


def place_name(title: Column) -> Column:
    """What a bare title 'music of x' or 'music in x' is about; null: another title."""
    name = F.regexp_extract(title, r"^music (?:of|in) (?:the )?(.+)$", 1)
    return F.when(name != "", name)


def region_kind(title: Column, source: Column) -> Column:
    """The kind of region that a bare title stands for, with the help of the bare title of the page that it was found on."""
    place = F.coalesce(place_name(title), title)
    inside = F.when(holds(title, ("ancient ", "colonial ", "medieval ")), "historical_region").when(F.contains(source, F.lit("by city")), "city")
    inside = inside.when(F.contains(source, F.lit("by locality")) | holds(place, DISTRICTS) | F.contains(source, F.lit("federal subject")), "subregion").otherwise("city")
    kind = F.when(F.startswith(title, F.lit("music in ")), inside).when(holds(title, ("ancient ", "medieval ", "renaissance ")), "historical_region")
    kind = kind.when(F.contains(title, F.lit("diaspora")), "diaspora_region").when(F.contains(title, F.lit("indigenous")), "cultural_region")
    kind = kind.when(F.contains(source, F.lit(" by dependent territory")) | holds(place, TERRITORIES), "territory").when(place.isin(*CONTINENTS), "continent")
    kind = kind.when(F.contains(source, F.lit("by country")), "country").when(holds(source, ("by state", "by province", "by region", "by territory")) | holds(place, PARTS), "subregion")
    return kind.otherwise("unknown")


def triage(rows: DataFrame, final: bool = False) -> DataFrame:
    """rows (title, source_title, candidate_type, confidence; suggested_name, if there is one, names the region first) with status, region,
    kind, sure and reason.

    The first round accepts and rejects what is clear and leaves the rest to a review; the ``final`` one accepts what is plausible. A
    rule's confidence is the least: a candidate's own, if it is higher, stays, but for the first round's rejections.
    """
    title, source, of = bare("title"), bare("source_title"), F.col("candidate_type")
    kind = region_kind(title, source)
    unknown = F.lit("unknown")
    past = title.rlike("^(?:music history of|classical music in|history of music in) ")

    def case(when: Column, status: str, k: Column, least: float, reason: str):
        return when, F.struct(F.lit(status).alias("status"), k.alias("kind"), F.lit(least).alias("least"), F.lit(reason).alias("reason"))

    if final:
        cases = [
            case(holds(title, NOISE + LATE_NOISE), "reject", unknown, 0.9, "institution or media"),
            case(title.rlike("^(?:timeline of |the music of )"), "reject", unknown, 0.86, "documentary page"),
            case(title.rlike(r"^.+\s+\(\d{4}[-–]\d{4}\)$"), "reject", unknown, 0.82, "period"),
            case(of == "region_container_category", "accept", kind, 0.78, "container"),
            case(of == "music_region_category", "accept", kind, 0.82, "regional category"),
            case(of == "cultural_region_page", "accept", kind, 0.76, "cultural page"),
            case(of == "unknown_music_candidate", "accept", F.when(past, "historical_region").otherwise(kind), 0.7, "ambiguous candidate"),
            case(F.lit(True), "accept", kind, 0.72, "plausible candidate"),
        ]
    else:
        cases = [
            case(holds(title, NOISE), "reject", unknown, 0.96, "institution or media"),
            case(title.rlike(BOX), "needs_review", unknown, 0.6, "container title"),
            case(of.isin("music_region_page", "traditional_music_page", "indigenous_music_page", "historical_music_page"), "accept", kind, 0.88, "page of a region or tradition"),
            case(of == "music_region_category", "accept", kind, 0.88, "regional category"),
            case(of == "region_container_category", "needs_review", unknown, 0.72, "container category"),
            case(of == "regional_music_list", "accept", unknown, 0.82, "regional list"),
            case(of.isin("cultural_region_page", "diaspora_region_page"), "needs_review", kind, 0.7, "cultural or diaspora page"),
            case((of == "regional_genre_page") & (holds(title, STYLE) | holds(source, STYLE_SOURCE)), "accept", kind, 0.74, "regional style"),
            case(of == "regional_genre_page", "needs_review", kind, 0.58, "possible regional style"),
            case((of == "unknown_music_candidate") & title.rlike("^(?:music history of|classical music in) "), "needs_review", kind, 0.62, "regional history"),
            case((of == "unknown_music_candidate") & holds(title, ("folk music", "traditional music", "indigenous", "diaspora", " music")) & holds(source, PLAIN_SOURCE), "needs_review", kind, 0.62, "ambiguous candidate"),
            case(F.lit(True), "needs_review", kind, 0.5, "too little evidence"),
        ]
    out = F.when(*cases[0])
    for c in cases[1:]:
        out = out.when(*c)
    given = F.nullif("suggested_name", F.lit("")) if "suggested_name" in rows.columns else F.lit(None).cast("string")
    sure = F.when((F.col("_t.status") == "reject") & F.lit(not final), F.col("_t.least")).otherwise(F.greatest(F.col("confidence"), F.col("_t.least")))
    return rows.withColumn("_t", out).select(*rows.columns, "_t.status", F.coalesce(given, place_name(title)).alias("region"), "_t.kind", sure.alias("sure"), "_t.reason")
