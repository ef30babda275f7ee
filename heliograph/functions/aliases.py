"""A catalog of canonical terms with aliases and home fields, as column expressions.

A catalog is configuration: tens of terms, held as literals in the plan. Terms are matched in their normalized form.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliograph.functions.text import none_of_strings, normalize, normalized

# The default catalog, its home fields, and the words of negation.
DEFAULT_ALIASES = {
    "人物": ["人", "男人", "女人", "行人", "游客", "儿童", "小孩", "男子", "女子"],
    "汽车": ["车", "轿车", "小汽车", "车辆", "机动车"],
    "自行车": ["单车", "脚踏车"],
    "摩托车": ["摩托", "机车"],
    "狗": ["犬", "小狗"],
    "猫": ["小猫"],
    "建筑": ["楼房", "大楼", "房屋"],
    "商店": ["店铺", "店面", "商铺"],
    "餐馆": ["饭店", "餐厅", "饭馆"],
    "城市": ["城区", "都市"],
    "街道": ["街景", "马路", "道路"],
    "室内": ["屋内", "房间内"],
    "室外": ["户外", "露天"],
    "夜晚": ["夜间", "夜景", "晚上"],
    "白天": ["日间", "日景"],
    "黄昏": ["傍晚", "日落时分"],
    "红色": ["红", "红颜色"],
    "蓝色": ["蓝", "蓝颜色"],
    "绿色": ["绿", "绿颜色"],
    "冷色": ["冷色调", "偏冷"],
    "暖色": ["暖色调", "偏暖"],
    "雨天": ["下雨", "雨夜", "雨景"],
    "雪天": ["下雪", "雪景"],
    "晴天": ["晴朗", "阳光明媚"],
}
DEFAULT_FIELDS = {
    "objects": ["人物", "汽车", "自行车", "摩托车", "狗", "猫", "建筑", "商店", "餐馆"],
    "scene": ["城市", "街道", "室内", "室外"],
    "time_of_day": ["夜晚", "白天", "黄昏"],
    "weather": ["雨天", "雪天", "晴天"],
    "colors": ["红色", "蓝色", "绿色", "冷色", "暖色"],
}
NEGATIVE_PREFIXES = ["不要", "没有", "无", "不含", "排除", "避开"]
NEGATIVE_EXCEPTIONS = ["无人机"]
#: What may stand between a word of negation and the term.
LINKS = ("", "有", "任何", "的")


def _map(pairs: dict[str, Column], kind: str) -> Column:
    flat = [x for k, v in pairs.items() for x in (F.lit(k), v)]
    return F.create_map(*flat) if flat else F.create_map().cast(f"map<string,{kind}>")


def met(aliases: Column, values: Column) -> Column:
    """A one-letter alias must be a whole value, a longer one lie in it."""
    return F.exists(aliases, lambda a: F.exists(values, lambda v: F.when(F.length(a) == 1, v == a).otherwise(v.contains(a))))


@dataclass
class Catalog:
    aliases: dict[str, list[str]] = field(default_factory=lambda: DEFAULT_ALIASES)
    fields: dict[str, list[str]] = field(default_factory=lambda: DEFAULT_FIELDS)
    prefixes: list[str] = field(default_factory=lambda: NEGATIVE_PREFIXES)
    exceptions: list[str] = field(default_factory=lambda: NEGATIVE_EXCEPTIONS)

    def names(self, canonical: str) -> list[str]:
        return list(dict.fromkeys([canonical, *self.aliases.get(canonical, [])]))

    def _canonical(self) -> dict[str, str]:
        return {normalized(a): c for c in self.aliases for a in self.names(c)}

    def canonicalize(self, term: Column) -> Column:
        return F.coalesce(_map({a: F.lit(c) for a, c in self._canonical().items()}, "string")[normalize(term)], F.trim(term))

    def expand(self, term: Column) -> Column:
        """Normalized aliases of a term; itself if the catalog doesn't have it."""
        known = {a: F.array(*[F.lit(normalized(n)) for n in self.names(c)]) for a, c in self._canonical().items()}
        return F.coalesce(_map(known, "array<string>")[normalize(term)], F.array(normalize(term)))

    def field_for(self, term: Column) -> Column:
        home = {c: f for f, cs in self.fields.items() for c in cs}
        return _map({c: F.lit(f) for c, f in home.items()}, "string")[self.canonicalize(term)]

    def matches(self, term: Column, values: Column) -> Column:
        """Whether any alias of the term is met in ``values``, which are normalized already."""
        return met(self.expand(term), values)

    def expanded(self, terms: Column) -> Column:
        """Terms as structs (t, a: aliases, home), so that what follows looks each of them up once."""
        return F.transform(terms, lambda t: F.struct(t.alias("t"), self.expand(t).alias("a"), self.field_for(t).alias("home")))

    def _without_exceptions(self, text: Column) -> Column:
        out = normalize(text)
        for e in self.exceptions:
            out = F.replace(out, F.lit(normalized(e)), F.lit(""))
        return out

    def _found(self, hits: list[tuple[str, Column]]) -> Column:
        return F.array_compact(F.array(*[F.when(hit, F.lit(c)) for c, hit in hits])) if hits else none_of_strings()

    def find(self, text: Column, home: str | None = None) -> Column:
        """Canonical terms of which the text has an alias, in the catalog's order."""
        low = self._without_exceptions(text)
        wanted = self.fields.get(home, []) if home else list(self.aliases)
        return self._found([(c, low.rlike("|".join(re.escape(normalized(a)) for a in self.names(c)))) for c in wanted])

    def find_excluded(self, text: Column) -> Column:
        low = self._without_exceptions(text)
        before = "(?:" + "|".join(re.escape(normalized(p)) for p in self.prefixes) + ")(?:" + "|".join(LINKS[1:]) + ")?(?:"
        return self._found([(c, low.rlike(before + "|".join(re.escape(normalized(a)) for a in self.names(c)) + ")")) for c in self.aliases])

    def remove_negative(self, text: Column, excluded: Column) -> Column:
        """The text without the phrases that exclude a term; punctuation becomes a space."""
        out = text
        before = "(?i)(?:" + "|".join(re.escape(p) for p in self.prefixes) + r")\s*(?:" + "|".join(LINKS[1:]) + r")?\s*(?:"
        for c in self.aliases:
            pattern = before + "|".join(re.escape(a) for a in self.names(c)) + ")"
            # one use of ``out`` a step: a branch on it would double the expression with each term
            out = F.regexp_replace(out, F.when(F.array_contains(excluded, c), F.lit(pattern)).otherwise(F.lit("(?!)")), F.lit(""))
        return F.coalesce(F.nullif(F.trim(F.regexp_replace(out, "[，,。；;]+", " ")), F.lit("")), F.trim(text))
