"""Free-form JSON detail: type-guarded reads, merges, shapes."""
from pyspark.sql import functions as F


def variant(text):
    return F.try_parse_json(text)


def number_at(v, path):
    """Value at the path only if it is a JSON number (or boolean); text never counts."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    is_num = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN")
    as_num = F.when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean").cast("double")).otherwise(
        F.try_variant_get(v, path, "double"))
    return F.when(is_num, as_num)


def text_at(v, path):
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))


def detail_shape(text):
    """Object as is, array wrapped under `items`, anything else an empty object."""
    kind = F.schema_of_variant(variant(text))
    return (F.when(kind.startswith("OBJECT"), text)
            .when(kind.startswith("ARRAY"), F.concat(F.lit('{"items":'), text, F.lit("}")))
            .otherwise(F.lit("{}")))


def signal_status(v, label):
    return F.coalesce(F.nullif(F.trim(text_at(v, "$.status")), F.lit("")),
                      F.nullif(F.trim(text_at(v, "$.label")), F.lit("")), F.lower(label))


def raw_total(v):
    """Stored raw total, else raw score plus boost."""
    return F.coalesce(number_at(v, "$.raw_total_before_normalization"),
                      number_at(v, "$.raw_score") + F.coalesce(number_at(v, "$.convergence_boost"), F.lit(0.0)))


def merge(base_map, extra_map):
    """Later keys win; both are map<string,string> of raw JSON values."""
    keep = F.map_filter(base_map, lambda k, _: ~F.array_contains(F.map_keys(extra_map), k))
    return F.map_concat(keep, extra_map)
