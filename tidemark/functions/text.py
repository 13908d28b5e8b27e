"""String, date and number functions as column expressions. White space is Unicode's, as in Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space for Java's regexes.
WS = r"(?U)\s"
#: The same as a list of characters.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def clean_text(c: Column) -> Column:
    """Runs of white space as one space, stripped; null as ''."""
    return strip(sub(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def clean_nbsp(c: Column) -> Column:
    """U+3000 and U+00A0 as spaces, stripped; inner runs stay."""
    return strip(F.translate(F.coalesce(c, F.lit("")), "　 ", "  "))


def normalize_text(c: Column) -> Column:
    c = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\u3000"), F.lit(" ")), F.lit("\xa0"), F.lit(" "))
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(sub(sub(c, r"[ \t]{2,}|\t", " "), r"\n{3,}", "\n\n"))


def nonblank(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def coalesce_str(*columns: Column) -> Column:
    return F.coalesce(*(nonblank(c) for c in columns), F.lit(""))


def extract_date(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\d{4}-\d{2}-\d{2}", 0), F.lit(""))


def norm_pub_time(c: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss from free text; a missing day is the 1st, offsets are dropped; '' if unreadable."""
    t = F.translate(F.translate(strip(F.coalesce(c, F.lit(""))), "年月/.", "----"), "日TZ", "   ")
    parts = r"(\d{4})-(\d{1,2})(?:-(\d{1,2}))?(?:\s+(\d{1,2})(?::(\d{1,2})(?::(\d{1,2}))?)?)?"
    part = [F.nullif(F.regexp_extract(t, parts, i), F.lit("")) for i in range(1, 7)]
    two = [F.lpad(F.coalesce(p, F.lit(d)), 2, "0") for p, d in zip(part[1:], ("1", "1", "0", "0", "0"))]
    made = F.try_to_timestamp(F.concat(part[0], F.lit("-"), two[0], F.lit("-"), two[1], F.lit(" "), two[2], F.lit(":"), two[3], F.lit(":"), two[4]), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(F.date_format(made, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


#: Accepted forms of a CSV time, in order.
TIME_FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd")


def parse_time(c: Column) -> Column:
    t = strip(c)
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in TIME_FORMS))


def keywords(c: Column) -> Column:
    """Words between ; , or white space, without the 关键词/keywords prefix."""
    bare = sub(strip(F.coalesce(c, F.lit(""))), r"(?i)^(关键词|关键字|keywords?)\s*[:：]\s*", "")
    return F.filter(F.split(F.translate(bare, "０！", ";,"), r"(?U)[;,\s]+"), lambda x: x != "")


def parse_keywords(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[；;、,，]\s*"), strip), lambda x: x != "")


def parse_float(c: Column, signed: bool = True) -> Column:
    """The first number, commas dropped; null without one."""
    return F.regexp_extract(F.replace(F.coalesce(c, F.lit("")), F.lit(",")), ("-?" if signed else "") + r"\d+(\.\d+)?", 0).try_cast("double")


def price_from_blob(c: Column) -> Column:
    """The number after a currency sign, else the first; "12 . 50" joins."""
    joined = sub(F.coalesce(c, F.lit("")), r"\s+", "")
    return F.coalesce(F.regexp_extract(joined, r"[¥￥](\d+(?:\.\d+)?)", 1).try_cast("double"), F.regexp_extract(joined, r"\d+(?:\.\d+)?", 0).try_cast("double"))


def mid_price(avg: Column, low: Column, high: Column) -> Column:
    return F.coalesce(avg, F.round((low + high) / 2, 2))


def price_per_kg(price: Column, grams: Column) -> Column:
    return F.when((price > 0) & (grams > 0), F.round(price / (grams / 1000), 2))


def strip_html(c: Column) -> Column:
    return strip(sub(F.coalesce(c, F.lit("")), r"<[^>]+>", ""))


def fallback_key(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(t == "", "unknown").otherwise(F.concat(F.lit("url#"), F.substring(F.md5(t), 1, 12)))


def sanitize_filename(c: Column) -> Column:
    return F.left(strip(sub(sub(F.coalesce(c, F.lit("")), r"[\\/*?:\"<>|]", ""), r"(?U)\s+", " ")), F.lit(120))


def parse_procity(c: Column) -> tuple[Column, Column]:
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")
    return F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def kv(c: Column, key: str) -> Column:
    """The value of key in a cookie text."""
    return F.nullif(F.regexp_extract(c, rf"(?:^|;\s*){key}=([^;]+)", 1), F.lit(""))


def token(value: Column) -> Column:
    """A cookie's value, up to the first '_' if it has one; null if nothing is left."""
    return F.nullif(strip(F.get(F.split(strip(value), "_", 2), F.lit(0))), F.lit(""))


def pct(c: Column) -> Column:
    """A share as a percentage of one place; N/A if it is no number."""
    return F.when(c.try_cast("double").isNotNull(), F.format_string("%.1f%%", c.try_cast("double") * 100)).otherwise("N/A")


def number(c: Column, digits: int = 2) -> Column:
    """A number of fixed places; N/A if it is none."""
    return F.when(c.try_cast("double").isNotNull(), F.format_string(f"%.{digits}f", c.try_cast("double"))).otherwise("N/A")


#: Key endings whose values are hidden.
SECRET_ENDINGS = ("pass", "password", "token", "secret", "cookie", "api_key", "key")


def redact(key: Column, value: Column) -> Column:
    return F.when(F.lower(key).rlike("(" + "|".join(SECRET_ENDINGS) + ")$") & (value != ""), "***REDACTED***").otherwise(value)


def md_title(c: Column, stem: Column) -> Column:
    found = strip(F.regexp_extract(c, r"(?m)^#+\s*(.+)$", 1))
    return F.when(found != "", found).otherwise(stem)


def absolute_url(c: Column, base: Column) -> Column:
    """'//' takes https, '/path' the base's origin, an absolute one stays; else the base's folder is put before it."""
    href = strip(F.coalesce(c, F.lit("")))
    origin = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    folder = sub(sub(base, r"[?#].*$", ""), r"^([a-z]+://[^/]+)$|/[^/]*$", "$1")
    return (
        F.when(href == "", "").when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.rlike("^https?://"), href)
        .when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(folder, F.lit("/"), href))
    )


def split_sentences(c: Column) -> Column:
    """Sentences that end in 。！？；!?; the full stop of Latin script ends none."""
    return F.filter(F.transform(F.split(normalize_text(c), r"(?<=[。！？；!?;])(?U)\s*"), strip), lambda x: x != "")


def chunks(c: Column, most: int = 1200) -> Column:
    """Sentences packed greedily into chunks of up to ``most`` characters; a longer sentence stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        fits = (F.length(acc["open"]) + F.length(s) <= most) | (acc["open"] == "")
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), F.when(fits, F.concat(acc["open"], s)).otherwise(s).alias("open"))

    sentences = split_sentences(c)
    folded = F.aggregate(sentences, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))
    return F.when(F.length(c) <= most, F.filter(F.array(F.array_join(sentences, "")), lambda x: x != "")).otherwise(folded)  # a short text is one chunk


def chain(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: sub(x, *s), steps, c)
