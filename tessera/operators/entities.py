"""Entity tables with their derived keys, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def enrich(df: DataFrame) -> DataFrame:
    """Keys of the first engine: (source, id, name, name_root, ... sorted_3gram), one row per record.

    Each projection builds on the one before, so that a regular expression runs once per record.
    """
    c = {x.lower(): x for x in df.columns}
    col = lambda *names: next((F.col(f"`{c[n]}`") for n in names if n in c), F.lit(None).cast("string"))
    id_ = col("entity_id", df.columns[0].lower()).cast("string")
    source = col("source") if "source" in c else F.lit("")
    a = df.select(
        source.alias("source"),
        id_.alias("id"),
        T.clean_text(col("business_name")).alias("name"),
        T.clean_text(col("business_address")).alias("addr"),
        T.clean_text(col("country")).alias("country"),
        T.first_digits(col("business_address")).alias("street_digits"),
        T.postal_code(col("business_address")).alias("postal_code"),
    )
    b = a.select(
        "*",
        T.strip_affixes(T.leet(F.col("name"))).alias("name_root"),
        T.standard_address(F.col("addr")).alias("addr_std"),
        T.standard_country(F.col("country")).alias("country_std"),
        T.unit_code(F.col("addr")).alias("unit_code"),
    )
    root = F.col("name_root")
    d = b.select(
        "*",
        T.sorted_tokens(root).alias("sorted_root"),
        T.nth_word(root, 1).alias("first_word"),
        T.nth_word(root, 2).alias("second_word"),
        T.acronym(root).alias("acronym"),
        T.address_core(F.col("addr_std")).alias("addr_core"),
        *[F.substring(root, 1, n).alias(f"root_prefix_{n}") for n in (5, 4, 3, 2)],
    )
    return d.select(
        "*",
        F.substring("addr_core", 1, 4).alias("addr_core_prefix_4"),
        T.letter_code(F.col("first_word")).alias("soundex_first"),
        T.letter_code(F.col("second_word")).alias("soundex_second"),
        T.consonants(F.col("first_word")).alias("consonant_stem"),
        T.sorted_letters(root).alias("sorted_3gram"),
    )


def clean(df: DataFrame, source: str = "") -> DataFrame:
    """Keys of the second engine, beside the columns of the input. Columns are found by name: id (entity_id, id, else
    the first), name (business_name, name), address (business_address, address), and country, phone, city, state, zip;
    what is missing is empty."""
    c = {x.lower(): x for x in df.columns}

    def col(*names: str):
        return next((F.col(f"`{c[n]}`").cast("string") for n in names if n in c), F.lit(""))

    first = {
        "id": col("entity_id", "id", df.columns[0].lower()),
        "source": F.col(f"`{c['source']}`") if "source" in c else F.lit(source),
        "clean_name_raw": T.clean_field(col("business_name", "name")),
        "clean_address": T.clean_address(T.clean_field(col("business_address", "address"))),
        "clean_country": T.clean_field(col("country")),
        "clean_city": T.clean_field(col("city")),
        "clean_state": T.clean_field(col("state")),
        "clean_zip": T.clean_zip(col("zip")),
        "clean_phone": T.clean_phone(col("phone")),
    }
    out = df.withColumns(first)
    out = out.withColumns({"clean_name": T.clean_name(F.col("clean_name_raw")), "clean_full_address": T.full_address(*(F.col(x) for x in ("clean_address", "clean_city", "clean_state", "clean_zip")))})
    return out.withColumns(
        {
            "meta_key": T.metaphone_key(F.col("clean_name")),
            "soundex_key": T.standard_soundex(F.col("clean_name")),
            "name_first_tokens": T.first_two_tokens(F.col("clean_name")),
            "street_digits_str": T.all_digits(F.col("clean_full_address")),
        }
    )
