"""Entities in posts: project type, budget, deadline, contacts.  One struct array per post, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import text as text_

#: Project types by markers, first that occurs wins.
PROJECT_TYPES = [
    ("ecommerce", ["интернет-магазин", "интернет магазин", "маркетплейс", "woocommerce"]),
    ("corporate_site", ["корпоративный сайт", "сайт компании"]),
    ("landing_page", ["лендинг", "одностраничник", "landing"]),
    ("business_card", ["визитка", "сайт-визитка"]),
    ("integration", ["crm", "api", "интеграция", "оплату", "платеж"]),
    ("redesign", ["редизайн", "перерисовать"]),
    ("revision", ["доработ", "правки", "починить", "исправить", "доделать"]),
    ("frontend", ["frontend", "фронтенд", "верстка", "вёрстка"]),
    ("backend", ["backend", "бэкенд", "бекенд"]),
    ("fullstack", ["fullstack", "фулстек", "под ключ"]),
]
#: Currency markers, and the patterns of amounts, deadlines and contacts.
CURRENCIES = {"₽": "RUB", "руб": "RUB", "р": "RUB", "rub": "RUB", "$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR", "грн": "UAH", "uah": "UAH", "тенге": "KZT", "kzt": "KZT", "бел": "BYN"}
_NUMBER, _SUFFIX, _CURRENCY = r"\d[\d\s.]*", r"(тыс|k|к)?", r"(руб\.?|р\.?|₽|rub|\$|usd|€|eur|грн|uah|тенге|kzt|бел)?"
MONEY = rf"(?iU)({_NUMBER})\s*{_SUFFIX}\s*{_CURRENCY}"
RANGE = rf"(?iU)(?:от\s+)?({_NUMBER})\s*{_SUFFIX}\s*(?:-|–|—|\s+до\s+)\s*({_NUMBER})\s*{_SUFFIX}\s*{_CURRENCY}"
UP_TO = rf"(?iU)до\s+({_NUMBER})\s*{_SUFFIX}\s*{_CURRENCY}"
NEGOTIABLE = r"(?U)\b(договорн\w*|по договор[её]нности|обсудим бюджет)\b"
EMAIL = r"(?iU)(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+(?![\w.+-])"
HANDLE = r"(?U)(?<![\w])@[a-zA-Z][\w\d_]{4,31}(?![\w])"
LINK = r"(?U)https?://t\.me/[a-zA-Z][\w\d_]{4,31}|(?<![\w])t\.me/[a-zA-Z][\w\d_]{4,31}"
PHONE = r"(?U)(?<!\d)\+?\d[\d\s()\-]{7,}\d(?!\d)"
URL = r"(?iU)https?://[^\s<>()]+"
IMPLICIT = r"(?iU)\b(в лс|в личк|пишите|комментарии)\b"
RELATIVE = r"(?U)\bза\s+(\d{1,2})\s+(дн(?:я|ей|ь)|недел[юьиь])\b"
BY_DATE = r"(?U)\b(?:до|к)\s+(\d{1,2})[./](\d{1,2})(?:[./](\d{2,4}))?\b"
MONTHS = {"январ": 1, "феврал": 2, "март": 3, "апрел": 4, "ма": 5, "июн": 6, "июл": 7, "август": 8, "сентябр": 9, "октябр": 10, "ноябр": 11, "декабр": 12}
BY_MONTH = r"(?U)\bк\s+(январ[юя]|феврал[юя]|март[ау]?|апрел[юя]|ма[юя]|июн[юя]|июл[юя]|август[ау]?|сентябр[юя]|октябр[юя]|ноябр[юя]|декабр[юя])\b"
URGENT = r"(?U)\b(срочно|дедлайн|горит)\b"

VALUE = (
    "struct<phrase:string,weight:int,category:string,is_regex:boolean,is_fuzzy:boolean,distance:int,project_type:string,amount_from:bigint,amount_to:bigint,"
    "currency:string,negotiable:boolean,deadline:date,mode:string,deadline_text:string,urgent:boolean,kind:string,value:string>"
)
ENTITY = f"struct<type:string,value_text:string,value_norm:{VALUE},confidence:decimal(5,4)>"
_KINDS = dict(f.split(":") for f in VALUE[len("struct<") : -1].split(","))
_NOTHING = f"named_struct({', '.join(f"'{n}', cast(null as {t})" for n, t in _KINDS.items())})"


def entity(type_: str, text: Column, confidence: Column | float, **values: Column) -> Column:
    norm = F.expr(_NOTHING)
    for n, v in values.items():
        norm = norm.withField(n, v.cast(_KINDS[n]))
    confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(F.lit(type_).alias("type"), text.alias("value_text"), norm.alias("value_norm"), confidence.cast("decimal(5,4)").alias("confidence"))


def none() -> Column:
    return F.array().cast(f"array<{ENTITY}>")


def project_type(text: Column, rules: list | None = None) -> Column:
    """At most one entity: the first rule with a marker in the text."""
    out = none()
    for kind, markers in reversed(PROJECT_TYPES if rules is None else rules):
        for m in reversed(markers):
            out = F.when(text.contains(m), F.array(entity("project_type", F.lit(m), 0.95, project_type=F.lit(kind)))).otherwise(out)
    return out


def amount(raw: Column, suffix: Column) -> Column:
    """Digits only, times 1000 for a thousands suffix; null if it does not fit a long."""
    return F.try_multiply(F.regexp_replace(raw, r"(?U)\D", "").try_cast("long"), F.when(F.lower(suffix).isin("тыс", "k", "к"), 1000).otherwise(1))


def currency(raw: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair])
    return table[F.replace(F.lower(raw), F.lit("."), F.lit(""))]


def budget(text: Column, strict: bool = False) -> Column:
    """At most one entity: negotiable, else a range, else an upper limit, else the first amount with a currency or suffix.

    By default a range needs no currency, and a date after "до" reads as an amount; strict=True asks ranges and
    limits for a currency or suffix too.
    """
    no = F.lit(False)

    def in_range(m: Column) -> Column:
        g = lambda i: F.regexp_extract(m, RANGE, i)
        return entity("budget", m, 0.95, amount_from=amount(g(1), g(2)), amount_to=amount(g(3), g(4)), currency=currency(g(5)), negotiable=no)

    def up_to(m: Column) -> Column:
        g = lambda i: F.regexp_extract(m, UP_TO, i)
        return entity("budget", m, 0.9, amount_to=amount(g(1), g(2)), currency=currency(g(3)), negotiable=no)

    def single(m: Column) -> Column:
        g = lambda i: F.regexp_extract(m, MONEY, i)
        return text_.bound(amount(g(1), g(2)), lambda once: entity("budget", m, 0.9, amount_from=once, amount_to=once, currency=currency(g(3)), negotiable=no))

    # a whole match is taken once; its groups are read from the match, not from the text
    found = lambda p: F.regexp_extract(text, p, 0)
    told = lambda m, p, *groups: (m != "") & ((F.concat(*[F.regexp_extract(m, p, g) for g in groups]) != "") if strict else F.lit(True))
    money = F.filter(F.regexp_extract_all(text, F.lit(MONEY), F.lit(0)), lambda m: (F.regexp_extract(m, MONEY, 2) != "") | currency(F.regexp_extract(m, MONEY, 3)).isNotNull())
    first = text_.bound(F.get(money, F.lit(0)), lambda m: F.when(m.isNull(), none()).otherwise(F.array(single(m))))
    limit = text_.bound(found(UP_TO), lambda m: F.when(told(m, UP_TO, 2, 3), F.array(up_to(m))).otherwise(first))
    amounts = text_.bound(found(RANGE), lambda m: F.when(told(m, RANGE, 2, 4, 5), F.array(in_range(m))).otherwise(limit))
    negotiable = text_.bound(found(NEGOTIABLE), lambda m: F.when(m != "", F.array(entity("budget", m, 0.9, negotiable=F.lit(True)))).when(text.rlike(r"\p{Nd}"), amounts).otherwise(none()))
    return negotiable


def deadline(text: Column, as_of: Column) -> Column:
    """At most one entity: in N days or weeks, by a date, by a month, or urgent words.  A date that does not exist gives a null deadline."""
    today = F.to_date(as_of)
    group = lambda p, i: F.regexp_extract(text, p, i)
    days = group(RELATIVE, 1).try_cast("int") * F.when(group(RELATIVE, 2).startswith("нед"), 7).otherwise(1)
    raw = group(BY_DATE, 3)
    year = F.when(raw == "", F.year(today)).otherwise(F.when(raw.try_cast("int") < 100, raw.try_cast("int") + 2000).otherwise(raw.try_cast("int")))
    on = lambda y: F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(group(BY_DATE, 2), 2, "0"), F.lpad(group(BY_DATE, 1), 2, "0")), "yyyy-MM-dd")
    dated = F.when((raw == "") & (on(year) < today), on(year + 1)).otherwise(on(year))
    name = group(BY_MONTH, 1)
    month = F.lit(None).cast("int")
    for stem, n in sorted(MONTHS.items(), key=lambda x: len(x[0])):
        month = F.when(name.startswith(stem), n).otherwise(month)
    by_month = F.try_to_date(F.concat_ws("-", (F.year(today) + F.when(month >= F.month(today), 0).otherwise(1)).cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lit("01")), "yyyy-MM-dd")
    digits = text.rlike(r"\p{Nd}")
    return (
        F.when(digits & text.rlike(RELATIVE), F.array(entity("deadline", group(RELATIVE, 0), 0.9, deadline=F.date_add(today, days), mode=F.lit("relative"))))
        .when(digits & text.rlike(BY_DATE), F.array(entity("deadline", group(BY_DATE, 0), 0.9, deadline=dated, mode=F.lit("date"))))
        .when(text.rlike(BY_MONTH), F.array(entity("deadline", group(BY_MONTH, 0), 0.9, deadline=by_month, mode=F.lit("month"))))
        .when(text.rlike(URGENT), F.array(entity("deadline", group(URGENT, 0), 0.8, deadline_text=group(URGENT, 0), urgent=F.lit(True))))
        .otherwise(none())
    )


def contacts(text: Column) -> Column:
    """Handles, links to chats, e-mails, phones, other urls; each (kind, value) once, by its first text; else an implicit contact by hint words."""
    nothing = F.array().cast("array<string>")
    every = lambda p, sign: F.when(sign, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(nothing)
    at, digits = text.contains("@"), text.rlike(r"\p{Nd}")  # cheap signs without which a pattern need not run
    one = lambda kind, m, value: entity("contact", m, 0.95, kind=F.lit(kind), value=value)
    found = F.concat(
        F.transform(every(HANDLE, at), lambda m: one("telegram_username", m, F.lower(m))),
        F.transform(every(LINK, text.contains("t.me/")), lambda m: one("telegram_username", m, F.concat(F.lit("@"), F.lower(F.regexp_extract(m, r"t\.me/(.*)$", 1))))),
        F.transform(every(EMAIL, at), lambda m: one("email", m, F.lower(m))),
        F.transform(every(PHONE, digits), lambda m: one("phone", m, F.regexp_replace(m, r"(?U)[^\d+]", ""))),
        F.transform(F.filter(every(URL, text.contains("://")), lambda m: ~F.lower(m).contains("t.me/")), lambda m: one("url", m, m)),
    )
    # found is bound, so the patterns run once and not for each contact
    same = lambda a, b: (a["value_norm"]["kind"] == b["value_norm"]["kind"]) & (a["value_norm"]["value"] == b["value_norm"]["value"])
    once = lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda y: same(x, y)))
    implicit = F.array(entity("contact", F.lit("implicit_contact"), 0.5, kind=F.lit("implicit"), value=F.lit("direct_message")))
    return text_.bound(found, lambda all_: F.when(F.size(all_) > 0, once(all_)).when(text.rlike(IMPLICIT), implicit).otherwise(none()))
