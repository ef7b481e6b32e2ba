"""Entity records: JSON lines -> merchants, personal-data terms, anomalies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askledger.functions import text as tx
from askledger.functions import variants as va
from askledger.operators import anomaly as an
from askledger.operators.skew import HOT_ROWS, keep_first, spread_join
from askledger.operators.weblogs import ORDER, line_problems, parse_lines

STAGE = "inputs"
# The record key that fills each column.
COLUMN_KEYS = {
    "opening_date": "merchant_opening_date",
    "city": "Seller_City_Name",
    "industry_tagged": "wwic_industry_tagged",
    "sub_category": "merchant_sub_category",
    "email": "Seller_Email_Address",
    "phone": "Business_Phone_No",
    "street": "Seller_Street_Address",
    "signer_name": "Primary_Authorized_Signer_Name",
    "owner_name": "Significant_Owner_Name",
    "owner_city": "Significant_Owner_City_Name",
    "owner_postal": "Significant_Owner_Postal_Code",
    "owner_street": "Significant_Owner_Street_Address",
    "website": "website",
    "country": "sell_ctry_cd",
    "state": "state_name",
}
# The record keys that feed each field of personal data.
TERM_KEYS = {
    "name": ("se_toc_name", "sell_dba_nm", "sell_lgl_nm"),
    "street": (
        "Seller_Street_Address",
        "Significant_Owner_Street_Address",
        "Authorized_Signer_Physical_Address",
    ),
    "city": ("Seller_City_Name", "Significant_Owner_City_Name"),
    "zip": ("Significant_Owner_Postal_Code", "sell_pstl_cd"),
    "phone": ("Business_Phone_No",),
    "email": ("Seller_Email_Address",),
    "owner": ("Significant_Owner_Name", "Primary_Authorized_Signer_Name"),
}
# Fixed value: shorter terms would match inside ordinary words.
MIN_TERM = 3


def _variants(field: str, value: Column) -> list[Column]:
    """The forms of one value a query may contain."""
    base = tx.term_text(value)
    if field == "phone":
        return [base, F.regexp_replace(value, "[^0-9]", "")]
    if field == "email":
        at = F.contains(base, F.lit("@"))
        local = F.substring_index(base, "@", 1)
        return [
            base,
            F.when(at, local),
            F.when(at, F.substr(base, F.length(local) + 2)),
        ]
    return [base]


def term_array(value_of, fields: Mapping[str, Sequence[str]] = TERM_KEYS) -> Column:
    """Distinct (field, value_norm) pairs of one record; `value_of(key)` is the key's text."""
    forms = [
        F.struct(F.lit(field).alias("field"), form.alias("value_norm"))
        for field, keys in fields.items()
        for key in keys
        for form in _variants(field, value_of(key))
    ]
    return F.array_distinct(
        F.filter(F.array(*forms), lambda t: F.coalesce(F.length(t["value_norm"]), F.lit(0)) >= MIN_TERM)
    )


def explode_terms(df: DataFrame, fields: Mapping[str, Sequence[str]], key: str = "se10") -> DataFrame:
    """Terms from plain columns: which columns feed a field is a parameter."""
    return (
        df.select(key, F.explode(term_array(lambda c: F.col(c).cast("string"), fields)).alias("t"))
        .select(key, "t.*")
        .distinct()
    )


def record_key(value: Column) -> Column:
    """Entity key as text, from the record's se10 member; NULL when missing or empty."""
    return F.nullif(va.text_or_dump(value), F.lit(""))


def shred(bronze: DataFrame) -> DataFrame:
    """One row per line: the entity's columns, its terms, and the line's problems."""
    v = F.col("v")
    keys = sorted({"se10", *COLUMN_KEYS.values(), *(k for ks in TERM_KEYS.values() for k in ks)})
    parsed = (
        parse_lines(bronze)
        .withColumn("m", va.members(v, keys))
        .withColumns(
            {
                "is_object": F.col("m").isNotNull(),
                "se10": record_key(F.col("m.se10")),
                # each key once as text, however many columns and terms it feeds
                "texts": F.struct(*[va.text_or_dump(F.col(f"m.{k}")).alias(k) for k in keys]),
            }
        )
    )
    head = F.col("raw")
    found = an.problems(
        *line_problems(v, "input record"),
        (
            v.isNotNull() & ~F.col("is_object"),
            an.problem(
                "RECORD_NOT_AN_OBJECT", F.format_string("input record is %s", va.describe(v)), head
            ),
        ),
        (
            F.col("is_object") & F.col("se10").isNull(),
            an.problem("MERCHANT_NO_SE10", F.lit("record has no se10 and cannot be joined"), head),
        ),
    )
    return parsed.select(
        *ORDER,
        "se10",
        *[va.plain_text(F.col(f"m.{key}")).alias(c) for c, key in COLUMN_KEYS.items()],
        F.col("raw").alias("raw_json"),
        F.when(F.col("se10").isNotNull(), term_array(lambda key: F.col(f"texts.{key}"))).alias("terms"),
        found.alias("problems"),
    )


def merchants(shredded: DataFrame) -> DataFrame:
    """One row per entity: the first by file and line, with its terms."""
    return keep_first(shredded.filter("se10 is not null").drop("problems"), ["se10"], ORDER)


def pii_terms(kept: DataFrame) -> DataFrame:
    """(entity, field, value) of the kept records; distinct by construction."""
    return kept.select("se10", F.explode("terms").alias("t")).select("se10", "t.*")


def duplicate_entities(shredded: DataFrame, min_hot: int = HOT_ROWS) -> DataFrame:
    """Later records of an entity, with the place of the first."""
    rows = shredded.filter("se10 is not null").select("se10", *ORDER, "raw_json")
    repeated = (
        rows.groupBy("se10")
        .agg(F.min(F.struct(*ORDER)).alias("first"), F.count(F.lit(1)).alias("n_copies"))
        .filter("n_copies > 1")
    )
    return spread_join(rows, repeated, ["se10"], "inner", ORDER, min_hot).filter(
        F.struct(*ORDER) > F.col("first")
    )


def anomalies(shredded: DataFrame, min_hot: int = HOT_ROWS) -> DataFrame:
    """Everything that was wrong in the entity records."""
    return an.union_all(
        [
            an.from_problems(shredded.drop("se10"), STAGE),
            an.anomaly(
                duplicate_entities(shredded, min_hot), STAGE, "DUP_INPUT_SE10",
                F.format_string(
                    "se10 %s was already read at %s:%d; this copy is not stored",
                    "se10", "first.src_file", "first.src_line",
                ),
                F.col("raw_json"),
            ),
        ]
    )


def without_terms(kept: DataFrame) -> DataFrame:
    """Entities stored, their terms, and how many entities gave none. One row."""
    return kept.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.coalesce(F.sum(F.size("terms")), F.lit(0)).cast("bigint").alias("n_terms"),
        F.count_if(F.size("terms") == 0).alias("n_without_terms"),
    )
