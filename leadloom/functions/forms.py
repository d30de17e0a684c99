"""Contact forms of static HTML: fields, their meaning, the best form, message templates. Nothing is submitted."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions import fixed

_TEXT = ("tag", "type", "name", "id", "placeholder", "label", "selector")
FIELD = T.StructType([*[T.StructField(n, T.StringType()) for n in _TEXT], T.StructField("required", T.BooleanType()), T.StructField("hidden", T.BooleanType())])
FORM = T.StructType([T.StructField("index", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("action", "method", "submit_selector")], T.StructField("captcha", T.BooleanType()), T.StructField("fields", T.ArrayType(FIELD))])
_UNSEEN = re.compile(r"display:\s*none|visibility:\s*hidden", re.I)
_CLEAR = re.compile(r"opacity:\s*0(?:\.0*)?\s*(?:;|$)", re.I)


def _escaped(name: str) -> str:
    """A name as it stands in a selector."""
    out = re.sub(r"[^\w\-]", lambda m: "\\" + m[0], name)
    return re.sub(r"^(\d)", lambda m: f"\\{ord(m[1]):x} ", out)


class _Forms(HTMLParser):
    def __init__(self):
        super().__init__()
        self.forms, self.form, self.captcha = [], None, False
        self.by_id: dict[str, str] = {}
        #: open label: the id it is for, its words, the fields inside it
        self.label: tuple[str, list[str], list[dict]] | None = None
        self.count: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "iframe" and any(w in a.get("src", "") for w in fixed.CAPTCHA_FRAMES) or set(a.get("class", "").split()) & set(fixed.CAPTCHA_CLASSES):
            self.captcha = True
        style = a.get("style", "")
        if tag == "form":
            self.count = {}
            self.form = {"index": len(self.forms), "action": a.get("action", ""), "method": a.get("method", "get").lower(), "submit": [None, None, None], "unseen": bool(_UNSEEN.search(style)) or "hidden" in a, "fields": []}
            self.forms.append(self.form)
        elif tag == "label":
            self.label = (a.get("for", ""), [], [])
        if self.form is None:
            return
        kind = a.get("type", "").lower()
        if tag in ("input", "textarea", "select"):
            self.count[tag] = self.count.get(tag, 0) + 1
            kind = {"textarea": "textarea", "select": "select-multiple" if "multiple" in a else "select-one"}.get(tag, kind or "text")
            hidden = kind == "hidden" or "hidden" in a or bool(_UNSEEN.search(style) or _CLEAR.search(style))
            nth = f"form:nth-of-type({self.form['index'] + 1})"
            selector = "#" + _escaped(a["id"]) if a.get("id") else f'{nth} [name="{_escaped(a["name"])}"]' if a.get("name") else f"{nth} {tag}:nth-of-type({self.count[tag]})"
            field = {"tag": tag, "type": kind, "name": a.get("name", ""), "id": a.get("id", ""), "placeholder": a.get("placeholder", ""), "label": "", "selector": selector, "required": "required" in a, "hidden": hidden}
            self.form["fields"].append(field)
            if self.label is not None:
                self.label[2].append(field)
        # what sends the form, by preference
        place = 0 if tag in ("button", "input") and kind == "submit" else 1 if tag == "button" and kind not in ("button", "reset") else 2 if a.get("role") == "button" else None
        if place is not None and self.form["submit"][place] is None:
            self.form["submit"][place] = "#" + _escaped(a["id"]) if a.get("id") else f"form:nth-of-type({self.form['index'] + 1}) button"

    def handle_endtag(self, tag):
        if tag == "form":
            self.form = None
        elif tag == "label" and self.label is not None:
            owner, words, inside = self.label
            said = re.sub(r"\s+", " ", "".join(words)).strip()
            if owner:
                self.by_id.setdefault(owner, said)
            for f in inside:
                f["label"] = said
            self.label = None

    def handle_data(self, data):
        if self.label is not None:
            self.label[1].append(data)

    def found(self) -> list[dict]:
        """Seen forms with their fields; a label for a field's id goes before the one around it."""
        out = []
        for form in self.forms:
            if form["fields"] and not form.pop("unseen"):
                for f in form["fields"]:
                    f["label"] = ((self.by_id.get(f["id"]) if f["id"] else "") or f["label"])[:100]
                out.append(form | {"submit_selector": next((x for x in form.pop("submit") if x), ""), "captcha": self.captcha})
        return out


@F.pandas_udf(T.ArrayType(FORM))
def detect_forms(html: pd.Series) -> pd.Series:
    """The seen forms of each page that have fields; captcha: whether the page has one."""

    def one(h):
        p = _Forms()
        p.feed(h or "")
        return p.found()

    return html.map(one)


def classify(field: Column) -> Column:
    """Kind of a field: by type and tag, else by its words; a company name is a company. Null if unknown."""
    words = F.concat_ws(" ", field["name"], field["placeholder"], field["label"])
    out = F.when(field["type"] == "email", "email").when(field["type"] == "tel", "phone").when(field["tag"] == "textarea", "message")
    for kind, pattern in fixed.FIELD_WORDS.items():
        out = out.when(words.rlike(pattern), F.when(words.rlike(fixed.FIELD_WORDS["company"]), "company").otherwise("name") if kind == "name" else F.lit(kind))
    return out


def best_forms(pages: DataFrame, key: str, forms: str) -> DataFrame:
    """key, form index, kinds: for each page the form with most kinds of visible fields that has email and message; the first of equals."""
    one = pages.select(key, F.explode(forms).alias("form"))
    kinds = F.array_distinct(F.array_compact(F.transform(F.filter(one["form"]["fields"], lambda f: ~f["hidden"]), classify)))
    fit = one.select(key, one["form"]["index"].alias("index"), kinds.alias("kinds")).where(F.array_contains("kinds", "email") & F.array_contains("kinds", "message"))
    w = W.partitionBy(key).orderBy(F.size("kinds").desc(), F.col("index"))
    return fit.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def render(template: Column, company: Column, city: Column, address: Column, email: Column, phone: Column, sender: Column) -> Column:
    """The template with its five variables filled; as it is if it names any other."""
    values = {"company_name": F.coalesce(company, F.lit("your company")), "city": F.coalesce(city, address, F.lit("")), "sender_email": email, "sender_phone": phone, "sender_company": sender}
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    odd = F.size(F.filter(F.regexp_extract_all(template, F.lit(r"\{([^{}]*)\}"), F.lit(1)), lambda v: ~v.isin(*values))) > 0
    return F.when(odd, template).otherwise(out)
