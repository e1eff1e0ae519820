"""Names, identifiers, formatting and validation of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_cell(x: Column) -> Column:
    return F.when(x.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def valid_name(x: Column, most: int = 100) -> Column:
    return F.char_length(F.trim(x)).between(1, most)


def plot_name(number: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("Plot "), number.cast("string")))


def valid_result_id(x: Column) -> Column:
    return x.rlike(r"^[A-Za-z0-9_-]{1,64}$")


def valid_hex_color(x: Column) -> Column:
    return x.rlike(r"^#([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6})$")


def valid_field_key(x: Column, reserved: tuple[str, ...] = ()) -> Column:
    return x.rlike(r"^[a-z][a-z0-9_]{0,39}$") & ~x.isin(*reserved) if reserved else x.rlike(r"^[a-z][a-z0-9_]{0,39}$")


def valid_ortho_id(x: Column) -> Column:
    return x.rlike(r"^ortho_[0-9]+$")


def valid_plugin_id(x: Column) -> Column:
    return x.rlike(r"^[a-z0-9_-]+$")


def valid_uuid(x: Column) -> Column:
    return x.rlike(r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def owned_photo(layer: Column, file: Column) -> Column:
    rest = F.substring(file, F.char_length(layer) + 1, F.char_length(file))
    return F.startswith(file, layer) & rest.rlike(r"^_[0-9]{10,}\.(jpg|jpeg|png|webp)$")


def safe_file_name(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}\p{N}._-]", "_")


def layer_id(x: Column, default: str = "layer") -> Column:
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(x, r"[^A-Za-z0-9_-]", "_"), 1, 64), F.lit("")), F.lit(default))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def suffixed(name: Column, n: Column) -> Column:
    """"name (n).ext"."""
    tail = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(" ("), n.cast("string"), F.lit(")"), tail)


def short_id(x: Column) -> Column:
    return F.left(x, F.lit(8))


def humanized(key: Column) -> Column:
    """snake_case to Title Case; only first letters change."""
    return F.array_join(F.transform(F.split(key, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.char_length(w)))), " ")


def area_text(m2: Column) -> Column:
    return F.when(m2 >= 10000, F.format_string("%.2f ha", m2 / 10000)).otherwise(F.format_string("%.1f m²", m2))


def length_text(m: Column) -> Column:
    return F.when(m >= 1000, F.format_string("%.2f km", m / 1000)).otherwise(F.format_string("%.1f m", m))


def indicator_text(value: Column, unit: Column) -> Column:
    number = F.when(F.abs(value) >= 100, F.format_string("%.0f", value)).otherwise(F.format_string("%.2f", value))
    return F.concat_ws(" ", number, unit)


def detection_id(image: Column, model: Column, seq: Column) -> Column:
    return F.format_string("%s-%s-%04d", image, model, seq)


def manual_id(x: Column) -> Column:
    return F.when(F.startswith(x, F.lit("manual-")), x).otherwise(F.concat(F.lit("manual-"), x))


def coordinates(text: Column) -> Column:
    """Lines "lat,lon" as an array of [lon, lat]; other lines are skipped."""
    parts = F.transform(F.split(text, r"\r?\n"), lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y).try_cast("double")))
    good = F.filter(parts, lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())
    return F.transform(good, lambda p: F.array(p[1], p[0]))


def image_format(header: Column, ext: Column) -> Column:
    """jpeg or dng by magic and extension; else the reason why not."""
    magic = F.hex(header)
    jpeg, tiff = magic.startswith("FFD8FF"), magic.startswith("49492A00") | magic.startswith("4D4D002A")
    return F.when(ext.isin("jpg", "jpeg"), F.when(jpeg, "jpeg").otherwise("magic_mismatch")).when(ext == "dng", F.when(tiff, "dng").otherwise("magic_mismatch")).otherwise("unsupported_format")


def progress(line: Column, schema: str = "percent int, message string") -> Column:
    """The record behind "PROGRESS:", null on other lines."""
    return F.when(F.startswith(line, F.lit("PROGRESS:")), F.from_json(F.substring(line, F.lit(10), F.char_length(line)), schema))


def crs_name(code: Column) -> Column:
    """"EPSG:n" and what is known of it."""
    zone = lambda side: F.format_string(f" (UTM Zone %d{side})", code % 100)
    known = F.when(code == 4326, " (WGS84 Geodetic)").when(code == 3857, " (Web Mercator)").when(code.between(32601, 32660), zone("N")).when(code.between(32701, 32760), zone("S")).otherwise("")
    return F.concat(F.format_string("EPSG:%d", code), known)


def destination_name(path: Column) -> Column:
    """Basename to copy to; null for an empty one, "." and ".."."""
    name = basename(path)
    return F.when(~name.isin("", ".", ".."), name)


def first_text(*candidates: Column) -> Column:
    """The first that isn't blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in candidates))


def value_text(value: Column, text: Column, unit: Column) -> Column:
    """"%.4f unit" of a value, else the text."""
    return F.coalesce(F.when(value.isNotNull(), F.concat_ws(" ", F.format_string("%.4f", value), F.nullif(unit, F.lit("")))), text)


def job_id(at: Column, unique: Column) -> Column:
    """exec_{YYYYMMDD}_{8 hex}, the hex from a UUID."""
    return F.concat(F.lit("exec_"), F.date_format(at, "yyyyMMdd"), F.lit("_"), F.left(F.replace(unique, F.lit("-")), F.lit(8)))


def aliases(table: DataFrame, alias: str = "alias", field: str = "field") -> DataFrame:
    """(alias_key, field): one field for each alias in lower case; of several, that of the alias that sorts first."""
    return table.groupBy(F.lower(alias).alias("alias_key")).agg(F.min_by(field, alias).alias(field))


# How a feature is named by the first property it has.
DISPLAY = (("tree_id", "Pohon"), ("path_id", "Jalur"), ("plot_id", "Petak"), ("land_cover_class", "Tutupan"), ("vegetation_index_type", "Vegetasi"))


def feature_name(properties: Column, place: Column) -> Column:
    """Display name of a feature from its map of properties, or its place, counted from 0."""
    named = [F.concat(F.lit(f"{label}: "), F.nullif(F.try_element_at(properties, F.lit(k)), F.lit(""))) for k, label in DISPLAY]
    return F.coalesce(*named, F.concat(F.lit("Fitur #"), (place + 1).cast("string")))


def feature_id(properties: Column, place: Column) -> Column:
    """plot_id, tree_id or path_id as a file name, else feat_ and the place, counted from 0."""
    ids = F.coalesce(*(F.try_element_at(properties, F.lit(k)) for k in ("plot_id", "tree_id", "path_id")))
    return F.coalesce(safe_file_name(ids), F.format_string("feat_%04d", place + 1))
