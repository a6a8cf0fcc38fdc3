"""Text, key and path expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The coarse families, in the order that settles ties.
FAMILIES = (
    "ambient_newage",
    "blues_funk_soul",
    "cinematic",
    "classical_orchestral",
    "electronic_dance",
    "experimental",
    "folk_country",
    "hiphop_rnb",
    "jazz",
    "latin",
    "metal",
    "pop",
    "reggae_caribbean",
    "rock_alternative_punk",
    "world_traditional",
)

#: Tags with a known family.
EXACT_FAMILY = {
    "8bit": "electronic_dance",
    "adultcontemporary": "pop",
    "americana": "folk_country",
    "americannative": "world_traditional",
    "asian": "world_traditional",
    "bachata": "latin",
    "balkan": "world_traditional",
    "batucada": "latin",
    "bolero": "latin",
    "bossanova": "latin",
    "cabaret": "cinematic",
    "calypso": "reggae_caribbean",
    "celtic": "world_traditional",
    "chansonfrancaise": "pop",
    "christian": "pop",
    "cumbia": "latin",
    "dancehall": "reggae_caribbean",
    "dub": "reggae_caribbean",
    "easylistening": "pop",
    "fado": "world_traditional",
    "fanfare": "classical_orchestral",
    "flamenco": "latin",
    "folklore": "world_traditional",
    "garage": "rock_alternative_punk",
    "gospel": "blues_funk_soul",
    "gothic": "rock_alternative_punk",
    "gypsy": "world_traditional",
    "indian": "world_traditional",
    "indie": "rock_alternative_punk",
    "jingle": "cinematic",
    "kidsquirky": "cinematic",
    "klezmer": "world_traditional",
    "lofi": "electronic_dance",
    "mambo": "latin",
    "manouche": "jazz",
    "march": "classical_orchestral",
    "mariachi": "latin",
    "medieval": "world_traditional",
    "merengue": "latin",
    "middleeastern": "world_traditional",
    "oriental": "world_traditional",
    "ragga": "reggae_caribbean",
    "ragtime": "jazz",
    "rai": "world_traditional",
    "reggaeton": "latin",
    "rocksteady": "reggae_caribbean",
    "rumba": "latin",
    "salsa": "latin",
    "samba": "latin",
    "ska": "reggae_caribbean",
    "spokenword": "experimental",
    "swing": "jazz",
    "tango": "latin",
    "tribal": "world_traditional",
    "waltz": "classical_orchestral",
    "western": "folk_country",
    "world": "world_traditional",
    "zouk": "reggae_caribbean",
}

#: Words whose presence in a tag decides its family; the first family counts.
KEYWORD_FAMILY = (
    ("metal", ("metal", "deathcore", "grindcore", "sludge", "stoner")),
    ("hiphop_rnb", ("hiphop", "rap", "rnb", "grime", "trap", "chillhop")),
    ("jazz", ("jazz", "bebop")),
    ("blues_funk_soul", ("blues", "funk", "soul")),
    ("classical_orchestral", ("classical", "baroque", "chamber", "choral", "opera", "symphonic", "piano")),
    ("folk_country", ("folk", "country", "bluegrass", "singersongwriter")),
    ("reggae_caribbean", ("reggae", "rocksteady", "dancehall", "ragga", "calypso", "ska")),
    ("world_traditional", ("afric", "afro", "asian", "indian", "oriental", "tribal", "world", "celtic")),
    ("cinematic", ("filmscore", "corporate", "production", "trailer", "musicbed", "jingle", "stinger", "logo", "intro", "loop")),
    ("ambient_newage", ("ambient", "newage", "chillout", "downtempo", "drone")),
    ("experimental", ("experimental", "avantgarde", "industrial", "noise", "glitch", "spokenword")),
    ("electronic_dance", ("electro", "electronic", "techno", "house", "trance", "dance", "edm", "synth", "wave", "dubstep", "drumnbass", "break", "jungle", "idm")),
    ("rock_alternative_punk", ("rock", "punk", "grunge", "emo", "shoegaze", "hardcore", "indie")),
    ("latin", ("latin", "bachata", "bossa", "cumbia", "flamenco", "salsa", "samba", "tango")),
    ("pop", ("pop", "easylistening")),
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Trimmed of white space of any kind; null when nothing is left."""
    return F.nullif(F.regexp_replace(_col(c), r"^\s+|\s+$", ""), F.lit(""))


def clean_float(c) -> Column:
    """A finite double, or null."""
    x = _col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def casefold(c) -> Column:
    """Lower case for comparison: beyond lower(), sharp s becomes ss and a final sigma a sigma."""
    return F.translate(F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss")), "ς", "σ")


def labels(v) -> Column:
    """The labels that a VARIANT holds, as an array of strings: a text is one label, an array's
    values are one each (null stays null, an object is its JSON text), all else has none."""
    v = _col(v)
    one = lambda x: F.when(~F.is_variant_null(x), F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))
    kind = F.schema_of_variant(v)
    several = F.transform(F.try_variant_get(v, "$", "array<variant>"), one)
    return F.when(kind.startswith("ARRAY"), several).when(kind == "STRING", F.array(F.try_variant_get(v, "$", "string"))).otherwise(F.array().cast("array<string>"))


def normalize_genres(c) -> Column:
    """Trimmed, casefolded, distinct, sorted labels of an array (null: empty); of a scalar or an
    array in a VARIANT: normalize_genres(labels(v))."""
    cleaned = F.transform(F.coalesce(_col(c), F.array().cast("array<string>")), lambda x: casefold(clean_text(x)))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull())))


def namespaced_tags(namespace: str, c) -> Column:
    return F.transform(normalize_genres(c), lambda x: F.concat(F.lit(f"{namespace}:"), x))


def style_tags(genres, instruments, vartags) -> Column:
    """Sorted union of the three namespaces."""
    both = F.array_union(namespaced_tags("genre", genres), namespaced_tags("instrument", instruments))
    return F.array_sort(F.array_union(both, namespaced_tags("vartag", vartags)))


def artist_key(artist_id, name, strict: bool = False) -> Column:
    """id:<id>, else name:<casefolded name>, else null, or an error if strict."""
    none = [F.raise_error(F.lit("a row without an artist id or name"))] if strict else []
    return F.coalesce(F.concat(F.lit("id:"), clean_text(artist_id)), F.concat(F.lit("name:"), casefold(clean_text(name))), *none)


def record_artist_key(*columns) -> Column:
    """The first that is not blank."""
    return F.coalesce(*(clean_text(c) for c in columns))


def track_key(artist, track_id, audio) -> Column:
    """<artist>::<track id, else the audio file's folder>."""
    return F.concat(_col(artist), F.lit("::"), F.coalesce(clean_text(track_id), F.regexp_replace(_col(audio), r"/[^/]*$", "")))


def record_genres(values, fallback=None) -> Column:
    """Trimmed, distinct, sorted labels of an array, else of one fallback label; of a scalar or an
    array in a VARIANT: record_genres(labels(v))."""
    own = F.filter(F.transform(_col(values), clean_text), lambda x: x.isNotNull())
    one = F.filter(F.array(clean_text(fallback)), lambda x: x.isNotNull()) if fallback is not None else F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.when(F.size(own) > 0, own).otherwise(one)))


def safe_path_component(c, prefix: str = "item") -> Column:
    """A short portable file name: forbidden runs become _, blank or long names carry a digest."""
    value = _col(c)
    cleaned = F.regexp_replace(F.regexp_replace(value, r'[<>:"/\\|?*\x00-\x1f]+', "_"), r"^[ ._]+|[ ._]+$", "")
    return (
        F.when(cleaned == "", F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(value), 1, 12)))
        .when(F.length(cleaned) > 96, F.concat(F.substring(cleaned, 1, 80), F.lit("_"), F.substring(F.sha1(value), 1, 10)))
        .otherwise(cleaned)
    )


def slug(c, fallback="item", limit: int = 80) -> Column:
    """Letters, digits, dot, underscore and hyphen; other runs become one underscore. Dots,
    underscores and hyphens at the ends go; nothing left gives the fallback (a text or column)."""
    cleaned = F.regexp_replace(F.regexp_replace(_col(c), r"[^0-9A-Za-z._-]+", "_"), r"^[._-]+|[._-]+$", "")
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.substring(F.coalesce(F.nullif(F.substring(cleaned, 1, 80), F.lit("")), other), 1, limit)


def numbered_directory(index, name) -> Column:
    """Four digits of the index and the name's ASCII letters: 0007_Some_Name."""
    return F.concat(F.format_string("%04d", _col(index)), F.lit("_"), F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(nfkd_ascii(_col(name)), r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", ""), F.lit("")), F.lit("artist")))


def artist_directory(artist_id, artist_key) -> Column:
    """A directory by the artist's id, else by a digest of its key."""
    named = F.concat(F.lit("artist_"), safe_path_component(artist_id, "id"))
    return F.coalesce(F.when(_col(artist_id) != "", named), F.concat(F.lit("artist_name_"), F.substring(F.sha1(_col(artist_key)), 1, 12)))


@F.pandas_udf(T.StringType())
def nfkd_ascii(c: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is not ASCII (Spark has no such function)."""
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


@F.pandas_udf(T.StringType())
def _nfc(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


#: What counts as white space between words.
WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def canonical_caption(c) -> Column:
    """White space (Unicode's too) collapsed, NFC. Only texts beyond ASCII go through Python."""
    squeezed = F.trim(F.regexp_replace(_col(c), f"[{WHITE}]+", " "))
    return F.when(squeezed.rlike(r"[^\x00-\x7f]"), _nfc(F.when(squeezed.rlike(r"[^\x00-\x7f]"), squeezed))).otherwise(squeezed)


def caption_hash(c) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def milliseconds(seconds, audio, group: int) -> Column:
    """Seconds to whole milliseconds (half to even), else from a file stem's _start_end digits."""
    stem = F.regexp_extract(_col(audio), r"_(\d{9})_(\d{9})(?:\.[^./]*)?$", group)
    return F.coalesce(F.rint(_col(seconds) * 1000).cast("long"), F.nullif(stem, F.lit("")).try_cast("long"))


def track_identifier(track, audio, row) -> Column:
    """A record's track id; if blank, its audio file's folder without track_; else row_<row>."""
    folder = F.regexp_replace(F.regexp_extract(_col(audio), r"([^/]+)/+[^/]*$", 1), "^track_", "")
    return F.coalesce(_filled(track), _filled(folder), F.concat(F.lit("row_"), _col(row).cast("string")))


def clip_identifier(clip, audio, row) -> Column:
    """A record's clip id; if blank, its audio file's name without extension; else row_<row>."""
    stem = F.regexp_replace(F.regexp_extract(_col(audio), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(_filled(clip), _filled(stem), F.concat(F.lit("row_"), _col(row).cast("string")))


def _filled(c) -> Column:
    """Null for a blank text."""
    return F.when(F.trim(_col(c)) != "", _col(c))


def sample_id(artist, track, start_ms, end_ms, caption, artist_index=None) -> Column:
    """Stable identity of a clip; unknown times are named so. No artist name left: its index."""
    number = lambda c: F.when(_col(c).isNull(), F.lit("unknown")).otherwise(F.when(F.length(_col(c).cast("string")) > 9, _col(c).cast("string")).otherwise(F.lpad(_col(c).cast("string"), 9, "0")))
    other = "artist" if artist_index is None else F.concat(F.lit("artist_"), _col(artist_index).cast("string"))
    return F.concat_ws("__", F.lit("jmdmc"), F.concat(F.lit("a_"), slug(artist, other, 24)), F.concat(F.lit("t_"), slug(track, "unknown", 32)), F.concat(F.lit("s_"), number(start_ms)), F.concat(F.lit("e_"), number(end_ms)), F.concat(F.lit("c_"), caption_hash(caption)))


def direct_family(tag, exact: dict[str, str] | None = None, keywords=None) -> Column:
    """The family of a tag: by name, else by the first group with a word in it, else null."""
    tag = _col(tag)
    exact = EXACT_FAMILY if exact is None else exact
    keywords = KEYWORD_FAMILY if keywords is None else keywords
    found = F.element_at(F.create_map(*(F.lit(x) for kv in exact.items() for x in kv)), tag) if exact else F.lit(None).cast("string")
    by_word = F.lit(None).cast("string")
    for family, words in reversed(list(keywords)):
        hit = F.lit(False)
        for w in words:
            hit = hit | tag.contains(w)
        by_word = F.when(hit, F.lit(family)).otherwise(by_word)
    return F.coalesce(found, by_word)


def resolve_group(title, note, groups: dict[str, str], strict: bool = False) -> Column:
    """The group that title or note names (lower case; _ and - as spaces; runs collapsed); else
    null, or an error if strict."""
    table = F.create_map(*(F.lit(x) for kv in groups.items() for x in kv))
    squeeze = lambda c: F.trim(F.regexp_replace(F.lower(_col(c)), r"[\s_-]+", " "))
    none = [F.raise_error(F.concat_ws(" ", F.lit("unknown group:"), _col(title), _col(note)))] if strict else []
    return F.coalesce(F.element_at(table, squeeze(title)), F.element_at(table, squeeze(note)), *none)


def fixed(c, decimals: int = 4, count=None) -> Column:
    """A number with fixed decimals; NaN when there is none or the count is 0."""
    missing = _col(c).isNull() | F.isnan(_col(c))
    if count is not None:
        missing = missing | (_col(count) == 0)
    return F.when(missing, F.lit("NaN")).otherwise(F.format_string(f"%.{decimals}f", _col(c)))


def mean_std(mean, std, count, decimals: int = 4) -> Column:
    """mean ± deviation; NaN without values."""
    joined = F.concat_ws(" ± ", fixed(mean, decimals), fixed(std, decimals))
    return F.when(_col(count).isNull() | (_col(count) == 0) | _col(mean).isNull() | F.isnan(_col(mean)), F.lit("NaN")).otherwise(joined)


def stable_hash(seed: int, namespace: str, *keys) -> Column:
    """The order key of deterministic draws: sha256 of seed, namespace and keys."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(namespace), *(_col(k).cast("string") for k in keys)), 256)


def path_inside_root(c) -> Column:
    """True for a relative path that does not climb out of its root."""
    p = F.regexp_replace(_col(c), r"\\", "/")
    return ~p.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)") & (p != "")


def is_mp3(content, least_bytes: int = 4096) -> Column:
    """ID3 tag or MPEG frame sync at the start, and enough bytes."""
    head = F.hex(F.substring(_col(content), 1, 3))
    sync = (F.substring(head, 1, 2) == "FF") & F.substring(head, 3, 1).isin("E", "F")
    return ((head == "494433") | sync) & (F.length(_col(content)) >= least_bytes)
