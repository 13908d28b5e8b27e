"""Rule classifiers compiled to CASE expressions, ordered by (priority, id); rules may come as rows of a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import first_rule
from .text import price_per_kg, strip


@dataclass(frozen=True)
class TypeRule:
    id: int
    product_type: str
    pattern: str
    priority: int = 100
    confidence: float = 1.0


@dataclass(frozen=True)
class UnitRule:
    id: int
    pattern: str
    unit: str
    grams: float
    priority: int = 100


@dataclass(frozen=True)
class OriginRule:
    id: int
    pattern: str
    country: str | None
    province: str | None
    city: str | None
    origin: str | None
    priority: int = 100


#: The default dictionaries, hint lists and spec patterns.
TYPE_RULES = (
    TypeRule(0, "king_salmon", r"(帝王鲑|帝王三文鱼|king\s*salmon|chinook)", 10, 0.98),
    TypeRule(0, "rainbow_trout", r"(虹鳟|rainbow\s*trout)", 20, 0.98),
    TypeRule(0, "salmon_generic", r"(三文鱼|salmon)", 90, 0.70),
)
UNIT_RULES = (
    UnitRule(0, r"^(kg|千克|公斤)$", "kg", 1000.0, 10),
    UnitRule(0, r"^(g|克)$", "g", 1.0, 20),
    UnitRule(0, r"^(斤)$", "jin", 500.0, 30),
    UnitRule(0, r"^(两)$", "liang", 50.0, 40),
    UnitRule(0, r"^(lb|lbs|磅)$", "lb", 453.59237, 50),
    UnitRule(0, r"^(oz|盎司)$", "oz", 28.349523, 60),
)
ORIGIN_RULES = (
    OriginRule(0, "智利", "智利", None, None, "智利", 10),
    OriginRule(0, "挪威", "挪威", None, None, "挪威", 20),
    OriginRule(0, "法罗", "法罗群岛", None, None, "法罗群岛", 30),
    OriginRule(0, "青海", "中国", "青海", None, "中国-青海", 40),
    OriginRule(0, "新疆", "中国", "新疆", None, "中国-新疆", 50),
)
COUNTRY_HINTS = ("中国", "智利", "挪威", "法罗群岛", "冰岛", "丹麦", "加拿大", "俄罗斯")
PROVINCE_HINTS = ("青海", "新疆", "西藏", "甘肃", "云南", "四川", "辽宁", "黑龙江", "吉林")
FALLBACK = (("king salmon|chinook", "king_salmon"), ("rainbow trout", "rainbow_trout"), ("帝王鲑|帝王三文鱼", "king_salmon"), ("虹鳟", "rainbow_trout"), ("三文鱼|salmon", "salmon_generic"))
_UNIT = "(kg|g|克|千克|公斤|斤|两|lb|lbs|磅|oz|盎司)"
_PACK = r"(?:\s*(袋|包|盒|尾|条|片|只|罐|份))?"
WEIGHT = rf"(?i)(\d+(?:\.\d+)?)\s*{_UNIT}(?:\s*(?:x|X|×|\*)\s*(\d{{1,3}}))?{_PACK}"
COUNT_FIRST = rf"(?i)(\d{{1,3}})\s*(?:x|X|×|\*)\s*(\d+(?:\.\d+)?)\s*{_UNIT}{_PACK}"
PACK_COUNT = r"(\d{1,3})\s*(袋|包|盒|尾|条|片|只|罐|份)"


def rules_of(df: DataFrame, kind: type) -> tuple:
    """Rule rows as literals; a dictionary is small by its nature and bounded here."""
    rows = df.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 rules")
    names = kind.__dataclass_fields__
    return tuple(kind(**{k: r[k] for k in names if k in r.asDict() and r[k] is not None or k not in ("priority", "confidence")}) for r in rows)


def _ordered(rules: tuple, default: tuple) -> list:
    """By priority, then id; no rules at all means the default ones."""
    return sorted(rules or default, key=lambda r: (r.priority, r.id))


def _i(pattern: str) -> str:
    return "(?i)" + pattern


def _text(*cols: Column) -> Column:
    return strip(F.array_join(F.filter(F.array(*(strip(F.coalesce(c, F.lit(""))) for c in cols)), lambda x: x != ""), " "))


def classify_type(title: Column, keyword: Column, category: Column, rules: tuple[TypeRule, ...] = ()) -> Column:
    """struct(product_type, rule_id, confidence, matched); built-in rules have no id; falls back to plain words, then unknown."""
    text = _text(title, keyword, category)
    kind = "struct<product_type:string,rule_id:long,confidence:double,matched:string>"

    def made(name: str, rule_id: int | None, confidence: float, matched: Column) -> Column:
        return F.struct(F.lit(name), F.lit(rule_id or None).cast("long"), F.lit(confidence), matched).cast(kind)

    out = None
    for r in _ordered(rules, TYPE_RULES):
        hit, value = text.rlike(_i(r.pattern)), made(r.product_type, r.id, r.confidence, F.regexp_extract(text, _i(r.pattern), 0))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    plain = F.lit(None).cast("string")
    for words, name in FALLBACK:
        out = out.when(text.rlike(_i(words)), made(name, None, 0.5, plain))
    return out.otherwise(made("unknown", None, 0.0, plain))


def grams_of(unit: Column, rules: tuple[UnitRule, ...] = ()) -> tuple[Column, Column]:
    """(normalised unit, grams of one); an unknown unit stays and counts 1."""
    name, factor = None, None
    for r in _ordered(rules, UNIT_RULES):
        hit = unit.rlike(_i(r.pattern))
        name = F.when(hit, r.unit) if name is None else name.when(hit, r.unit)
        factor = F.when(hit, r.grams) if factor is None else factor.when(hit, r.grams)
    return name.otherwise(F.lower(unit)), factor.otherwise(1.0)


def weight_text(grams: Column) -> Column:
    """1000g, 1.5g: up to three places, '' for null or not positive."""
    text = F.round(grams, 3).cast("decimal(18,3)").cast("string")
    return F.when(grams > 0, F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("g"))).otherwise("")


def extract_spec(title: Column, spec: Column, rules: tuple[UnitRule, ...] = (), fix_count_prefix: bool = False) -> Column:
    """struct(spec_raw, value, unit, grams, count, total, weight).

    2×500g counts one pack, since the weight alone is found first; fix_count_prefix reads the count before it.
    """
    text = _text(title, spec)
    raw = F.regexp_extract(text, WEIGHT, 0)
    value = F.nullif(F.regexp_extract(text, WEIGHT, 1), F.lit("")).cast("double")
    own = F.nullif(F.regexp_extract(text, WEIGHT, 3), F.lit("")).cast("int")
    before = F.nullif(F.regexp_extract(text, COUNT_FIRST, 1), F.lit("")).cast("int") if fix_count_prefix else F.lit(None).cast("int")
    packs = F.nullif(F.regexp_extract(text, PACK_COUNT, 1), F.lit("")).cast("int")
    count = F.greatest(F.coalesce(own, before, packs, F.lit(1)), F.lit(1))
    unit, factor = grams_of(F.regexp_extract(text, WEIGHT, 2), rules)
    ok = value > 0
    grams = F.when(ok, F.round(value * factor, 3))
    total = F.when(ok, F.round(grams * count, 3))
    return F.struct(
        F.nullif(raw, F.lit("")).alias("spec_raw"), F.when(ok, value).alias("value"), F.when(ok, unit).alias("unit"), grams.alias("grams"),
        F.when(ok, count).alias("count"), total.alias("total"), F.coalesce(weight_text(total), F.lit("")).alias("weight"),
    )


def _compose(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "-")


def extract_origin(title: Column, province: Column, city: Column, origin: Column, rules: tuple[OriginRule, ...] = ()) -> Column:
    """struct(country, province, city, origin, rule_id); the seller's province and city fill what a rule leaves open."""
    text = _text(title, origin, province, city)
    p, c = F.nullif(strip(F.coalesce(province, F.lit(""))), F.lit("")), F.nullif(strip(F.coalesce(city, F.lit(""))), F.lit(""))
    kind = "struct<country:string,province:string,city:string,origin:string,rule_id:long>"
    out = None
    for r in _ordered(rules, ORIGIN_RULES):
        own_p, own_c = F.coalesce(F.lit(r.province).cast("string"), p), F.coalesce(F.lit(r.city).cast("string"), c)
        fixed = F.coalesce(F.lit(r.origin).cast("string"), F.lit(""))
        named = F.when(own_c.isNotNull() & ~fixed.contains(own_c), _compose(F.lit(r.country).cast("string"), own_p, own_c)).when(fixed == "", _compose(F.lit(r.country).cast("string"), own_p, own_c)).otherwise(fixed)
        hit = text.rlike(_i(r.pattern))
        value = F.struct(F.lit(r.country).cast("string"), own_p, own_c, named, F.lit(r.id or None).cast("long")).cast(kind)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    country, prov = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h in reversed(COUNTRY_HINTS):
        country = F.when(text.contains(h), h).otherwise(country)
    for h in reversed(PROVINCE_HINTS):
        prov = F.when(text.contains(h), h).otherwise(prov)
    prov = F.coalesce(p, prov)
    country = F.coalesce(country, F.when(F.lower(text).contains("norway"), "挪威").when(F.lower(text).contains("chile"), "智利"), F.when(prov.isNotNull(), "中国"))
    return out.otherwise(F.struct(country, prov, c, _compose(country, prov, c), F.lit(None).cast("long")).cast(kind))


def _cases(text: Column, *cases: tuple[str, str]) -> Column:
    out = None
    for pattern, value in cases:
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    return out


def storage_of_title(title: Column) -> Column:
    return _cases(title, ("冷冻", "frozen"), ("冰鲜", "ice_fresh"), ("鲜活", "live_fresh"), ("冷鲜", "cold_fresh"), ("鲜", "fresh"))


def storage_of_offline(text: Column) -> Column:
    return _cases(text, ("(?i)冷冻|冻品|速冻|frozen", "frozen"), ("(?i)冰鲜|ice.?fresh", "ice_fresh"), ("(?i)鲜活|活鲜|活|鲜|fresh|live", "fresh"))


def type_of_offline(name: Column) -> Column:
    return F.coalesce(
        _cases(name, (r"(?i)帝王鲑|帝王三文鱼|king\s*salmon|chinook", "king_salmon"), (r"(?i)虹鳟|rainbow\s*trout", "rainbow_trout"), ("(?i)三文鱼|salmon|鲑", "salmon_generic"), ("鳟", "trout_generic")),
        F.lit("aquatic_other"),
    )


#: Certification words; sc认证 is sought as written, the others in the lower-cased title.
CERTS = {"organic": ("有机", "organic"), "green_food": ("绿色食品",), "asc": ("asc",), "msc": ("msc",), "bap": ("bap",), "haccp": ("haccp",), "halal": ("halal",), "qs": ("qs",)}


def cert_flags(title: Column) -> dict[str, Column]:
    low, out = F.lower(title), {}
    for name, words in CERTS.items():
        hit = title.contains("sc认证") if name == "qs" else F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out[f"cert_{name}"] = hit.cast("int")
    return out


def flags(title: Column) -> dict[str, Column]:
    low = F.lower(title)
    return {
        "is_wild": (low.contains("野生") | low.contains("wild")).cast("int"),
        "is_fresh": (low.contains("鲜") & ~low.contains("冷冻")).cast("int"),
        "omega3": F.when(low.rlike("omega-?3"), 1.0),
    }


@dataclass(frozen=True)
class Rules:
    types: tuple[TypeRule, ...] = ()
    units: tuple[UnitRule, ...] = ()
    origins: tuple[OriginRule, ...] = field(default=())


def enrich(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All rule columns for items(title, keyword, category, spec, province, city, origin, price): one projection."""
    t = F.col("title")
    out = df.withColumns({
        "__t": classify_type(t, F.col("keyword"), F.col("category"), rules.types),
        "__s": extract_spec(t, F.col("spec"), rules.units),
        "__o": extract_origin(t, F.col("province"), F.col("city"), F.col("origin"), rules.origins),
    })
    return out.select(
        *(F.col(c) for c in df.columns), F.col("__t.product_type").alias("product_type"), F.col("__t.rule_id").alias("type_rule_id"), F.col("__t.confidence").alias("type_confidence"),
        F.col("__s.weight").alias("spec_weight_normalized"), F.col("__s.total").alias("total_grams"), F.col("__s.count").alias("pack_count"), F.col("__o.origin").alias("origin_standardized"),
        F.col("__o.country").alias("origin_country"), F.col("__o.province").alias("origin_province"), F.col("__o.city").alias("origin_city"), storage_of_title(t).alias("storage_method"),
        *(c.alias(n) for n, c in {**cert_flags(t), **flags(t)}.items()), price_per_kg(F.col("price"), F.col("__s.total")).alias("price_per_kg"),
    )


def classify_join(df: DataFrame, rules: DataFrame, text: str, key: str, most: int = 10_000) -> DataFrame:
    """(key, product_type) of each row: the first rule by (priority, id) whose pattern the text holds, else ``unknown``.

    The rule table is small by a check of its size. A null text is ``unknown``; of rows of equal key each has its own.
    """
    some = rules.select("priority", "id", "pattern", "product_type").limit(most + 1).collect()
    if len(some) > most:
        raise ValueError(f"more than {most:,} rules")
    ordered = [(r["pattern"], r["product_type"]) for r in sorted(some, key=lambda r: (r["priority"], r["id"])) if r["pattern"] is not None]
    return df.select(key, F.coalesce(first_rule(F.col(text), ordered), F.lit("unknown")).alias("product_type"))
