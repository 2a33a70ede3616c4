"""Names and forms of address that a text states, preferences for a brand's item, and what belongs to a user's profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramic.functions.text import any_of, bound, java, trim

# Patterns, without regard to case; the first group is the value.
NAMES = [r"(?:我的名字是|我(?:现在)?叫|本名是)\s*([^\s，。,.!！?？\"'“”‘’「」『』]+)", r"calls?\s+themselves\s+['\"]([^'\"]+)['\"]", r"name\s+is\s+['\"]?([^'\".,\n]+)['\"]?"]
ADDRESSES = [
    r"(?:以后你叫我|以后请叫我|请叫我|以后称呼我(?:为)?|称呼我(?:为)?|称呼其为|称呼他为)\s*([^\s，。,.!！?？\"'“”‘’「」『』]+)",
    r"(?:希望(?:在[^\n。]{0,20})?(?:以后)?(?:你)?(?:被)?称呼(?:我|其|他)?为)\s*([^\s，。,.!！?？\"'“”‘’「」『』]+)",
    r"(?:被称呼为|称呼偏好(?:是)?|Preferred address(?: is)?|be addressed as|addressed as)\s*['\"]?([^'\".,\n]+)['\"]?",
    r"(?:addressive identifier is|preferred (?:and permanently assigned )?addressive identifier is)\s*['\"]?([^'\".,\n]+)['\"]?",
]
NAME_HINTS = [r"(?m)^姓名[:：]", r"(?m)^## Identity$", r"(?:^|\n)-\s*Name:\s+", "用户当前姓名/自称为"]
ADDRESS_HINTS = [r"(?m)^称呼偏好[:：]", r"(?m)^## Addressing$", "Preferred form of address", "被称呼为", "addressive identifier"]
PROFILE_HINTS = [
    r"(?m)^User profile:", r"(?m)^##\s*(?:Background|Profile|Context)$", r"(?:^|\n)-\s*(?:Timezone|Pronouns?|Role|Language|Working style|Collaboration style)\s*:",
    r"(?:我的时区是|我的代词是|我是|我的身份是|my timezone is|my pronouns are|i am)\b", "(?:时区|代词|协作方式|工作方式|语言偏好)",
]
NAME_KEY, ADDRESS_KEY = "entities:姓名", "preferences:称呼偏好"
# The groups are the brand and the items, in the order of the second value.
BRAND_ITEMS = [
    (r"(?:^|[\s，,。；;！!？?])(?:我|用户)?(?:很|更|还)?(?:喜欢|爱吃|偏爱|常吃|想吃)(?:吃|喝|用|买)?([\p{IsHan}A-Za-z0-9&·'\-]{1,24})的([\p{IsHan}A-Za-z0-9&·'\-\s、,，和及与/]{1,80})", (1, 2)),
    (r"\b(?:i|user)?\s*(?:really\s+|still\s+|also\s+)?(?:like|love|prefer|enjoy)\s+([a-z0-9'&\-\s]{1,80})\s+from\s+([a-z0-9'&\-\s]{1,40})", (2, 1)),
]
CLAUSE_END, ITEM_SPLIT = "(?iu)(?:因为|所以|但是|不过|if |when |because |but )", "(?iu)(?:、|,|，|/|以及|及|与|和| and | & )"


def _value(text: Column, patterns: list[str]) -> Column:
    def cut(x: Column) -> Column:
        x = F.regexp_replace(x, r"""^[\s"'“”‘’「」『』*`_]+""", "")
        return bound(trim(F.regexp_replace(x, r"""[\s"'“”‘’「」『』*`_。！，、,.!?:：；;]+$""", "")), lambda v: F.when(v != "", v))

    return F.coalesce(*[cut(F.regexp_extract(text, "(?iu)" + java(p), 1)) for p in patterns])


def values(text: Column) -> Column:
    """struct(name, addressing) stated in a text."""
    t = trim(text)
    return F.struct(_value(t, NAMES).alias("name"), _value(t, ADDRESSES).alias("addressing"))


def slots(text: Column, fact_key: Column) -> Column:
    """struct(name, addressing): whether a row states or holds one of the two."""
    v = values(text)
    return F.struct(
        (F.coalesce(fact_key == NAME_KEY, F.lit(False)) | v["name"].isNotNull() | any_of(text, NAME_HINTS)).alias("name"),
        (F.coalesce(fact_key == ADDRESS_KEY, F.lit(False)) | v["addressing"].isNotNull() | any_of(text, ADDRESS_HINTS)).alias("addressing"),
    )


def belongs_to_profile(memory_category: Column, fact_key: Column, text: Column) -> Column:
    """Rows that a user's profile file holds in place of the store: profile, name, form of address."""
    s = slots(text, fact_key)
    return F.coalesce(memory_category == "profile", F.lit(False)) | any_of(text, PROFILE_HINTS) | s["name"] | s["addressing"]


def token(value: Column) -> Column:
    """A brand or item without quotes, articles and spaces, in lower case."""
    v = F.regexp_replace(trim(value), r"""^[“"'`‘’]+|[”"'`‘’。！!？?，,；;:：]+$""", "")
    return F.lower(F.regexp_replace(F.regexp_replace(v, r"(?i)" + java(r"\b(?:the|a|an)\s+"), ""), r"\s+", ""))


def brand_items(text: Column) -> Column:
    """struct(brand, items) of "like ITEMS from BRAND" or "喜欢BRAND的ITEMS", or null; speaker marks at line starts do not count."""
    t = trim(F.regexp_replace(F.regexp_replace(text, r"(?m)^\[(?:用户|助手)\]\s*", ""), r"\s+", " "))

    def parsed(pattern: str, brand: int, named: int) -> Column:
        found = lambda g: F.regexp_extract(t, "(?iu)" + java(pattern), g)
        items = F.filter(F.transform(F.split(F.split(found(named), CLAUSE_END, 2)[0], ITEM_SPLIT), token), lambda x: x != "")
        return F.when((token(found(brand)) != "") & (F.size(items) > 0), F.struct(token(found(brand)).alias("brand"), items.alias("items")))

    return F.coalesce(*[parsed(p, *groups) for p, groups in BRAND_ITEMS])


def atomic_slot(text: Column) -> Column:
    """struct(brand, item) where a text prefers one item alone."""
    p = brand_items(text)
    return F.when(F.size(p["items"]) == 1, F.struct(p["brand"].alias("brand"), p["items"][0].alias("item")))


def canonical(category: Column, abstract: Column, overview: Column, content: Column) -> Column:
    """struct(category, abstract, overview, content) of a candidate: in one form if it states a name or a form of address.

    An entity's name comes before its form of address, with other candidates the other way round.
    """
    said = F.concat_ws("\n", *[F.nullif(x, F.lit("")) for x in (abstract, overview, content)])
    v = values(said)
    source = F.coalesce(F.nullif(content, F.lit("")), abstract)

    def made(of: str, title: str, heading: str, label: str, sentence: str, alias: Column) -> Column:
        return F.struct(F.lit(of).alias("category"), F.concat(F.lit(f"{title}："), alias).alias("abstract"), F.concat(F.lit(f"## {heading}\n- {label}: "), alias).alias("overview"), F.concat(F.lit(f"{sentence}“"), alias, F.lit("”。原始表述："), source).alias("content"))

    name = F.when(v["name"].isNotNull(), made("entities", "姓名", "Identity", "Name", "用户当前姓名/自称为", v["name"]))
    address = F.when(v["addressing"].isNotNull(), made("preferences", "称呼偏好", "Addressing", "Preferred form of address", "用户希望以后被称呼为", v["addressing"]))
    same = F.struct(category.alias("category"), abstract.alias("abstract"), overview.alias("overview"), content.alias("content"))
    return F.when(category == "entities", F.coalesce(name, address, same)).otherwise(F.coalesce(address, name, same))


def kept_in_profile(memory_category: Column, fact_key: Column, text: Column, profile: bool = True, name: bool = True, addressing: bool = True) -> Column:
    """``belongs_to_profile`` for the routes that are on: profile rows and hints, names, forms of address."""
    return kept_by(profile_routes(memory_category, fact_key, text), profile, name, addressing)


def profile_routes(memory_category: Column, fact_key: Column, text: Column) -> Column:
    """struct(profile, name, addressing): the routes by which a row belongs to the profile; its text is searched once."""

    def found(t: Column) -> Column:
        s = slots(t, fact_key)
        hinted = F.coalesce(memory_category == "profile", F.lit(False)) | any_of(t, PROFILE_HINTS)
        return F.struct(hinted.alias("profile"), s["name"].alias("name"), s["addressing"].alias("addressing"))

    return bound(text, found)


def kept_by(routes: Column, profile: bool = True, name: bool = True, addressing: bool = True) -> Column:
    """Whether one of the routes that are on was found."""
    out = F.lit(False)
    for on, hit in [(profile, routes["profile"]), (name, routes["name"]), (addressing, routes["addressing"])]:
        out = out | hit if on else out
    return out
