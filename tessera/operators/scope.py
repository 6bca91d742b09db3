"""Anonymisation: symbols of each sample's scope, and texts with symbols replaced.

nodes: sample_id, node_id, label, attrs (map). A symbol is (sample_id, name, replacement, priority); the smallest priority
that holds a name wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .graph import node_order

MODES = ("raw", "semantic-anon", "full-anon")
_FAR = 1_000_000_000
#: Names of a sample that share a map.
SHELF = 4


def attribute(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def _first_truthy(*names: str) -> Column:
    return F.trim(F.coalesce(*[F.nullif(attribute(n), F.lit("")) for n in names], F.lit("")))


def scope_order() -> Column:
    """Line, column, node order, text; what has no line comes last."""
    number = lambda n: F.coalesce(F.expr(f"try_cast(try_element_at(attrs, '{n}') as int)"), F.lit(_FAR))
    return F.struct(number("LINE_NUMBER"), number("COLUMN_NUMBER"), *node_order(), F.concat_ws("|", attribute("NAME"), attribute("CODE")))


def scope_symbols(nodes: DataFrame, mode: str) -> DataFrame:
    """(sample_id, name, replacement, priority) of parameters, locals, fields, types, known calls and user functions. Names of a kind are
    numbered by first occurrence. Nodes are read once for all kinds and shuffled once, by sample; what follows needs no other shuffle."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    semantic = mode == "semantic-anon"
    name, known = _first_truthy("NAME", "CODE"), T.api_category(F.col("name"))
    kind = F.when(F.col("label") == "METHOD_PARAMETER_IN", 1).when(F.col("label") == "LOCAL", 2).when(F.col("label") == "FIELD_IDENTIFIER", 3).when(F.col("label") == "CALL", 6)
    of_kind = F.when(kind == 3, _first_truthy("CANONICAL_NAME", "NAME", "CODE")).when(kind.isNotNull(), name)
    types = F.when(attribute("TYPE_FULL_NAME") != "", T.type_identifiers(attribute("TYPE_FULL_NAME")))
    found = F.concat(F.array(F.struct(F.lit(-1).alias("pos"), kind.alias("kind"), of_kind.alias("name"))), F.coalesce(F.transform(types, lambda t, k: F.struct(k.alias("pos"), F.lit(4).alias("kind"), t.alias("name"))), F.array().cast("array<struct<pos:int,kind:int,name:string>>")))
    rows = nodes.select("sample_id", scope_order().alias("o"), F.explode(F.filter(found, lambda x: x["name"] != "")).alias("x"))
    rows = rows.select("sample_id", "x.kind", "x.name", F.struct("o", "x.pos").alias("at")).repartition("sample_id")
    first = rows.groupBy("sample_id", "kind", "name").agg(F.min("at").alias("at"))
    first = first.select("sample_id", "name", F.when((F.col("kind") == 6) & known.isNotNull(), 5).otherwise(F.col("kind")).alias("priority"), "at")
    n = F.row_number().over(Window.partitionBy("sample_id", "priority").orderBy("at"))
    prefix = F.when(F.col("priority") == 1, "PARAM_").when(F.col("priority") == 2, "VAR_").when(F.col("priority") == 3, "FIELD_").when(F.col("priority") == 4, "TYPE_" if mode == "full-anon" else "USER_TYPE_").otherwise("USER_FUNC_" if semantic else "FUNC_")
    replacement = F.concat(prefix, n.cast("string"))
    api = known
    if semantic:
        tags = T.semantic_tags(F.col("name"))
        replacement = F.concat(replacement, F.when((F.col("priority") != 4) & (F.size(tags) > 0), F.concat(F.lit(" "), F.array_join(tags, " "))).otherwise(""))
        api = F.when(T.api_category(F.col("name"), wrappers=False).isNotNull(), F.concat_ws(" ", "name", known)).otherwise(known)
    return first.select("sample_id", "name", F.when(F.col("priority") == 5, api).otherwise(replacement).alias("replacement"), "priority")


def _shelves(symbols: DataFrame) -> DataFrame:
    """(s, n, known): the names of each sample with their replacements as n maps; a name is in the one of its hash modulo n."""
    best = symbols.where("sample_id is not null").repartition("sample_id").groupBy(F.col("sample_id").alias("s"), "name").agg(F.min_by("replacement", "priority").alias("replacement"))
    known = best.groupBy("s").agg(F.collect_list(F.struct("name", "replacement", F.xxhash64("name").alias("h"))).alias("all"))
    known = known.withColumn("n", F.ceil(F.size("all") / SHELF))
    shelf = lambda k: F.map_from_entries(F.transform(F.filter("all", lambda x: F.pmod(x["h"], F.col("n")) == k), lambda x: F.struct(x["name"], x["replacement"])))
    return known.select("s", "n", F.transform(F.expr("sequence(0L, n - 1)"), shelf).alias("known"))


def _anonymised(codes: DataFrame, symbols: DataFrame, mode: str, *columns: str) -> DataFrame:
    """codes (sample_id, columns, code) with text in place of code. The names of a sample meet its codes as one array of maps, so only codes and
    symbols are shuffled, both by sample; tokens never are. A map is searched name by name, so each holds about SHELF of them, by hash."""
    names = fixed.C_KEYWORDS + fixed.BASIC_TYPES + ["NULL", "true", "false"]
    known = _shelves(symbols)
    d = codes.join(known, F.col("sample_id") == F.col("s"), "left")

    def named(word: Column) -> Column:
        other = T.unknown_name(word)
        if mode == "semantic-anon":
            tags = T.semantic_tags(word)
            other = F.concat(other, F.when(F.size(tags) > 0, F.concat(F.lit(" "), F.array_join(tags, " "))).otherwise(""))
        return F.when(word.isin(names), word).otherwise(F.coalesce(F.try_element_at(F.try_element_at("known", (F.pmod(F.xxhash64(word), F.col("n")) + 1).cast("int")), word), other))

    piece = lambda t: T.by_kind(t, STRING=F.lit("STR"), CHAR=F.lit("CHAR"), JOERN=t, HEX=F.lit("HEX"), INT=T.normalize_integer(t), FLOAT=F.lit("FLOAT"), ID=named(t), OP=t)
    return d.select("sample_id", *columns, F.coalesce(F.array_join(F.transform(T.lex(F.col("code")), piece), " "), F.lit("")).alias("text"))


def normalized_codes(codes: DataFrame, symbols: DataFrame, mode: str, key: str = "node_id") -> DataFrame:
    """(sample_id, key, text): code lexed, names looked up in the sample's symbols, literals by kind, tokens joined by one
    blank. Raw mode leaves texts alone. codes: sample_id, key, code. A null code is an empty text."""
    if mode == "raw":
        return codes.select("sample_id", key, F.col("code").alias("text"))
    return _anonymised(codes.select("sample_id", key, "code"), symbols, mode, key)


def normalized_nodes(nodes: DataFrame, symbols: DataFrame | None, mode: str) -> DataFrame:
    """(sample_id, node_id, text): a node by its label. Raw mode takes the raw node text; the others need symbols."""
    if mode == "raw":
        return nodes.select("sample_id", "node_id", T.node_text(F.col("label"), F.col("attrs")).alias("text"))
    if symbols is None:
        raise ValueError(f"{mode} needs the symbols of a scope")
    code = F.when(F.col("label") == "METHOD", F.trim(attribute("SIGNATURE"))).when(F.col("label") == "METHOD_RETURN", F.trim(attribute("TYPE_FULL_NAME"))).when(F.col("label") == "BLOCK", "").otherwise(_first_truthy("CODE", "NAME"))
    d = _anonymised(nodes.where("sample_id is not null and node_id is not null").select("sample_id", "node_id", "label", code.alias("code")), symbols, mode, "node_id", "label")
    mark = F.when(F.col("label") == "METHOD_RETURN", "RET").otherwise(F.col("label"))
    text = F.when(F.col("text") == "", F.concat(F.lit("<"), mark, F.lit(">"))).when(F.col("label").isin("METHOD", "METHOD_RETURN"), F.concat(F.lit("<"), mark, F.lit(" "), "text", F.lit(">"))).otherwise(F.col("text"))
    return d.select("sample_id", "node_id", text.alias("text"))
