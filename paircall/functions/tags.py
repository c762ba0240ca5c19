"""Optional alignment tags, kept as `map<string,string>` from key to `TYPE:VALUE`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# A field that is no KEY:TYPE:VALUE, or a key that comes twice.
_IRREGULAR = "(?:^|\t)(?!..:.:)|(?:^|\t)(..):[^\t]*\t(?:.*\t)?\\1:"


def parse_tags(fields: Column) -> Column:
    """Array of `KEY:TYPE:VALUE` strings to a map; for a repeated key the first one counts."""
    text = F.array_join(fields, "\t")
    return F.when(text.rlike(_IRREGULAR), _first_of_each(fields)).otherwise(
        F.str_to_map(text, F.lit("\t"), F.lit(":"))
    )


def _first_of_each(fields: Column) -> Column:
    well_formed = F.filter(fields, lambda f: f.rlike("^..:.:"))
    keys = F.transform(well_formed, lambda f: f.substr(1, 2))
    entries = F.transform(
        well_formed,
        lambda f: F.struct(f.substr(1, 2).alias("key"), f.substr(F.lit(4), F.length(f)).alias("value")),
    )
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


def tag(tags: Column, key: str) -> Column:
    """The raw `TYPE:VALUE` of a tag, or null."""
    return F.try_element_at(tags, F.lit(key))


def _typed(tags: Column, key: str, types: str, cast: str) -> Column:
    raw = tag(tags, key)
    return F.when(raw.substr(1, 1).isin(*types), raw.substr(F.lit(3), F.length(raw)).try_cast(cast))


def tag_int(tags: Column, key: str) -> Column:
    return _typed(tags, key, "cCsSiI", "long")


def tag_float(tags: Column, key: str) -> Column:
    return _typed(tags, key, "f", "float")


def tag_double(tags: Column, key: str) -> Column:
    return _typed(tags, key, "d", "double")


def tag_char(tags: Column, key: str) -> Column:
    return _typed(tags, key, "A", "string").substr(1, 1)


def tag_string(tags: Column, key: str) -> Column:
    return _typed(tags, key, "ZH", "string")


def drop_tags(tags: Column, *keys: str) -> Column:
    return F.map_filter(tags, lambda key, _: ~key.isin(*keys))


def keep_tag(tags: Column, key: str) -> Column:
    return F.map_filter(tags, lambda k, _: k == key)


def add_tag(tags: Column, key: str, type_: str, value: Column) -> Column:
    """Append a tag; an existing one under the same key stays."""
    extra = F.create_map(F.lit(key), F.concat(F.lit(type_ + ":"), value.cast("string")))
    return F.when(F.map_contains_key(tags, key), tags).otherwise(F.map_concat(tags, extra))
