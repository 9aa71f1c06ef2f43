"""Personal information in free text: detection, typed placeholders, and keyed surrogates.

Detection looks for email addresses, telephone numbers, identity numbers, street addresses and people's names, in one Arrow-batched
function in which spans found earlier hide their text from later kinds.  Every rule states the words or signs it can't do without; texts
without them never meet its expression.  Names are found by a grammar: capitalised words (Latin, Cyrillic, Greek) or a Chinese family name
with what follows, next to something only a person goes with: a title, a label, a greeting or closing, a verb of saying or meeting, a street address, a
home directory.  Words of roles, groups and machines are no names.

Surrogate generation: every distinct (kind, normal form) gets a replacement derived from an HMAC under a secret key.  Replacements keep type and
format: numbers go through a keyed permutation of their digits and keep grouping and prefix, names are drawn from lists of their script and, where
a title or given name tells it, gender; titles, mail notation and street words stay, mail goes to a reserved domain.  Spellings of one value get
the same replacement in their own spelling (coreference).  The collision check looks at every spelling of every value: a replacement that two values share, or
that is itself a value of the data, is derived again with the next counter until there is none.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loomspark.session import Scratch, spread

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

# Accounts of machines and roles; words that are no person's; words before names; titles; name particles; Chinese family names.
MACHINE_ACCOUNTS = set(
    "node ubuntu runner build builder vscode public shared root admin administrator jenkins default guest deploy service user users ci bot agent "
    "daemon nobody www www-data git github gitlab travis circleci codespace coder ec2-user azureuser vagrant docker postgres mysql nginx oracle hadoop "
    "spark airflow app dev test tester operator system local developer worker pi debian centos fedora jovyan sandbox workspace defaultuser public.all".split()
)
NO_PERSON = set(
    "team teams server servers thread threads platform build builds builder main practices practice service services system systems group groups department desk support admin administrator bot agent agents worker workers "
    "runner pipeline project company inc ltd gmbh corp university bank office release branch module queue job jobs task tasks process manager engine cluster node database api client customer host user users assistant "
    "everyone everybody nobody somebody anyone all world there folks sir madam friends colleagues both nothing something next test tests none null unknown todo done run keep please could would should "
    "the this that these those it i we you they he she a an in on at to of after before why where when which what who how if and or but not no yes so as is was were are be been has have had do does did "
    "my our your their his her its one two three first last new old many most some any each every other another".split()
)
#: Words that begin a sentence before a name.
LEADING = set("yesterday today tomorrow then later finally also meanwhile when while after before because since although gestern heute hier ayer hoy вчера сегодня".split())
TITLES = "Dr Ms Mr Mrs Miss Mx Mme Mlle M Herr Frau Prof Sr Sra Srta Señor Señora Don Doña г-н г-жа".split()
PARTICLES = "van von der den de del la le di da dos du ten ter al bin ibn af zu".split()
CJK_FAMILIES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
LABELS = (
    "signed-off-by co-authored-by reviewed-by acked-by reported-by name fullname nom nombre contact kontakt contacto patient patientin patiente paciente owner author auteur autor assignee reviewer customer caller recipient "
    "имя фио контакт όνομα επαφή"
).split()
CJK_LABELS = "姓名 联系人 患者 收件人 作者 负责人".split()
#: What is done by, or with, a person who is named next.
NAMED_AFTER = ["assign it to", "assign this to", "assign to", "assigned to", "assigned it to", "assigned this to", "reviewed by", "written by", "approved by", "reported by", "signed by", "spoke to", "spoke with", "talked to", "talked with", "my colleague", "our colleague", "mein kollege", "meine kollegin", "ma collègue", "mon collègue", "mi colega"]
MET = "met meeting phoned emailed visited thanked contacted interviewed hired".split()
SAYING = "asked wrote said called told replied answered reported presented suggested confirmed agreed joined mentioned explained emailed phoned requested proposed signed thinks says asks writes".split()
GREETINGS = ["dear", "hi", "hello", "hey", "hallo", "liebe", "lieber", "sehr geehrte", "sehr geehrter", "cher", "chère", "bonjour", "hola", "estimado", "estimada", "querido", "querida", "уважаемый", "уважаемая"]
CLOSINGS = ["gruß", "grüße", "viele grüße", "mit freundlichen grüßen", "regards", "kind regards", "best regards", "best", "cheers", "thanks", "cordialement", "saludos", "un saludo", "merci", "с уважением"]
#: Street words: such as are hardly anything else, and such as need an address around them.
STREETS, SOFT_STREETS = "Street St Road Rd Avenue Ave Lane Ln Court Ct Drive Dr Terrace Gardens Square Crescent Boulevard Blvd Mews Quay Wharf".split(), "Close Way Garden Hill Place Row Walk Parade Green Grove Park Bridge View Rise".split()
FRENCH_STREETS = "rue avenue boulevard impasse quai place allée chemin cours route square passage villa sentier faubourg".split()
SPANISH_STREETS = "calle avenida avda plaza paseo camino carrera ronda travesía carretera glorieta c/".split()
OTHER_STREETS = "Via Viale Piazza Corso Largo Rua Avenida Praça Travessa ul. Ulica ulica улица ул. проспект переулок Οδός οδός".split()
GERMAN_ENDINGS, NORTHERN_ENDINGS = "straße strasse str. weg gasse platz allee ufer damm ring markt".split(), "gatan vägen gade vej straat laan plein gracht katu veien".split()

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĹŁŃŇŌŐŘŚŠŤŪŮŰŹŻŽА-ЯЁЄІЇҐΑ-ΩΆΈΉΊΌΎΏ"
_any = lambda words: "(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"
_WORD = rf"[{_UP}][\w'’\-]*"
_TITLE = rf"(?:{_any(TITLES)}\.?\s+)"
_PART = rf"(?:{_any(PARTICLES)}\s+)"
_CORE = rf"(?:{_PART}*)(?:{_WORD}|[{_UP}]\.)(?:(?:,?[ \t]+|\.[ \t]+){_PART}*{_WORD}){{0,3}}"
_NAME = rf"{_TITLE}?{_CORE}"
#: The same in plain order and at least two words: for places where one capitalised word says too little.
_FULL = rf"{_TITLE}?(?:{_WORD}|[{_UP}]\.)(?:[ \t]+{_PART}*{_WORD}){{1,3}}"
_AT = r"(?:@|＠|%40|\s?[\[(]\s?at\s?[\])]\s?)"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)"
PLACEHOLDER = re.compile(r"\[(?:REDACTED|EMAIL|PHONE|ID_NUMBER|ADDRESS|NAME)[^\]\n]{0,40}\]|<[A-Za-z_ ]{1,30}>|\$\{?\w+\}?|%[A-Z]+%|\{\{\w+\}\}")
#: What looks like personal data but is none: hidden before the numbers are looked for.
NOISE = re.compile(
    r"\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b|\b(?:19|20)\d{2}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?|\bISBN(?:-1[03])?:?\s?[\d\- Xx]{10,17}|\b[A-Z]{2,10}-\d[\d\-]*\b|\b0x[0-9a-f]+|\bepoch \d+", re.I
)
EMAIL = re.compile(rf"(?<![\w.+\-/@＠%])(?:mailto:)?[\w+\-'’][\w.+\-'’]*{_AT}(?:[\w\-]+{_DOT})+[A-Za-z]{{2,24}}(?![\w\-]|:[\w/])", re.I)
EMAIL_PATH = re.compile(rf"(?<=-)(?:mailto:)?[^\W\-/][\w.+\-'’]*{_AT}(?:[\w\-]+{_DOT})+[A-Za-z]{{2,24}}(?![\w\-]|:[\w/])", re.I)
ID_NUMBER = re.compile(
    r"(?<![\w.\-/])(?:"
    r"\d{3}([- ])\d{2}\1\d{4}"
    r"|[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]"
    r"|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPQR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]|QQ\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]"
    r"|[12]\s\d{2}\s(?:0[1-9]|1[0-2])\s\d{2}\s\d{3}\s\d{3}(?:\s\d{2})?"
    r"|\d{2}\s\d{6}\s[A-Z]\s\d{3}"
    r")(?![\w\-]|\.\d)"
    r"|(?:passport|reisepass|passeport|pasaporte|护照)\s*(?:no\.?|nr\.?|number|num\.?|n[°º]|#|号码?)?\s*[:：#]?\s*(?=[A-Z0-9]*\d{5})[A-Z0-9]{7,10}\b"
    r"|(?<=/)\d{3}([- ])\d{2}\2\d{4}(?=/|$)|(?<=/)[1-9]\d{5}(?:19|20)\d{9}[\dX](?=/|$)|(?<=/)QQ\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D](?=/|$)",
    re.I,
)
PHONE = re.compile(
    r"(?<![\w.\-+#])(?:"
    r"(?:tel:)?\+\d{1,3}[ .\-]?(?:\(0\)[ ]?)?(?:\(\d{1,4}\)[ .\-]?)?\d{1,5}(?:[ .\-]?\d{2,5}){1,5}"
    r"|tel:\d[\d\-]{6,14}"
    r"|00[1-9]\d{0,2}(?:[ \-]\(?\d{1,5}\)?){2,5}"
    r"|\(\d{3}\)[ ]?\d{3}[ .\-]\d{4}"
    r"|\(0\d{1,4}\)[ ]?\d{3,5}[ \-]?\d{3,5}"
    r"|\d{3}([.\- ])\d{3}\1\d{4}"
    r"|0\d{4}[ ]\d{6}|0\d{3}[ ]\d{3}[ ]\d{4}|0\d{2}[ ]\d{4}[ ]\d{4}|0\d{4}[ ]\d{3}[ ]\d{3}|0\d{1,4}[ /\-]\d{4,8}|0[1-9](?:[ .]\d{2}){4}"
    r"|1[3-9]\d{9}|1[3-9]\d[ \-]\d{4}[ \-]\d{4}"
    r")(?![\w]|[\-.]\d)"
)
_STREET_NAME = rf"(?:[{_UP}][\w'’\-]*[ ]){{1,3}}"
_BIG_STREET = rf"(?<!\w)[{_UP}][\w\-]*"
_HOUSE = r"\d{1,4}(?:[ ]?[a-z])?\b"
#: Where a house number may begin, and end, if the street word is also something else.
_AROUND = (r"(?:(?<=^)|(?<=[\n:=,;(\"])|(?<=[:=,;.] )|(?<= at )|(?<= to )|(?<= in )|(?<= is )|(?<= from )|(?<= near )|(?<=^at )|(?<=^to ))", r"(?=\s*(?:$|[,\n;)\"]|\.(?:\s|$)))")
ADDRESS = re.compile(
    "|".join(
        [
            rf"(?:Flat[ ]\d{{1,4}}[a-z]?,[ ])?(?<![\d.])\d{{1,5}}[ ]?[a-z]?,?[ ]{_STREET_NAME}(?i:{'|'.join(STREETS)})\b\.?",
            rf"(?:Flat[ ]\d{{1,4}}[a-z]?,[ ])(?<![\d.])\d{{1,5}}[ ]?[a-z]?,?[ ]{_STREET_NAME}(?i:{'|'.join(SOFT_STREETS)})\b",
            rf"{_AROUND[0]}(?<![\d.])\d{{1,5}}[ ]?[a-z]?,?[ ]{_STREET_NAME}(?i:{'|'.join(SOFT_STREETS)})\b{_AROUND[1]}",
            rf"(?<=[/\\])\d{{1,5}}[ ]?[a-z]?,?[ ]{_STREET_NAME}(?i:{'|'.join(SOFT_STREETS)})\b",  # a folder of an address
            rf"{_BIG_STREET}(?i:{'|'.join(map(re.escape, GERMAN_ENDINGS + NORTHERN_ENDINGS))})[ ]{_HOUSE}",
            rf"{_BIG_STREET}[ ](?:Stra(?:ß|ss)e|STRA(?:ß|SS)E|Str\.|Weg|Gasse|Platz|Allee|Ufer|Damm|Ring)[ ]{_HOUSE}",
            rf"(?<!\w)(?:Am|An der|An den|Im|In der|Zum|Zur|Auf der|Auf dem|Unter den|Hinter dem|AM|IM)[ ](?:[A-Za-zÄÖÜäöüß]+[ ])?[{_UP}][\w\-]+[ ]{_HOUSE}(?=,|$|\n|[ ]in\b)",
            rf"(?<![\d.])\d{{1,5}}(?:[ ]?(?:bis|ter|quater|[A-D])\b)?,?[ ](?i:{'|'.join(FRENCH_STREETS)})[ ](?:(?i:de la|de l['’]|des|de|du|d['’]|la|le|les|aux?)[ ]?)?[\w'’\-]+",
            rf"(?<!\w)(?i:{'|'.join(map(re.escape, SPANISH_STREETS))})\.?[ ](?:[\w'’\-]+[ ]){{0,4}}[\w'’\-]+,?[ ](?:n[.º°]*[ ]?)?\d{{1,4}}\b",
            rf"(?<!\w)(?:{'|'.join(map(re.escape, OTHER_STREETS))})[ ](?:(?:{_WORD}|{'|'.join(PARTICLES)}|dei|delle|della|degli)[ ])*{_WORD},?[ ](?:n[.º°]*[ ]?)?{_HOUSE}",
            r"[一-鿿]{2,12}(?:路|街|巷|大道|胡同|弄)\d{1,5}(?:弄\d+)?号",
        ]
    )
)


def _needs(words: list[str], pattern: str, flags: int = 0) -> tuple[tuple[str, ...], re.Pattern]:
    """A rule, with the lower-case words one of which a text must hold to match it."""
    return tuple(w.lower() for w in words), re.compile(pattern, flags)


_HAN = rf"[{CJK_FAMILIES}][一-鿿]{{1,2}}"
NAME_RULES = [
    _needs(LABELS, rf"(?<![\w])(?i:full[ ]name|{'|'.join(map(re.escape, LABELS))})[ ]?[:=：][ ]?\"?(?P<n>{_NAME})"),
    _needs(CJK_LABELS, rf"(?:{'|'.join(CJK_LABELS)})[ ]?[:=：]?[ ]?(?P<n>[一-鿿·]{{2,8}}(?=$|[\s,;，。；、)）])|{_NAME})", re.M),
    _needs(NAMED_AFTER, rf"(?i:{_any(NAMED_AFTER)})[ ](?P<n>{_NAME})"),
    _needs(CLOSINGS, rf"(?i:(?<!\w){_any(CLOSINGS)})(?:,[ \n]|\n)(?P<n>{_NAME})\s*(?=$|\n)", re.M),
    _needs(GREETINGS, rf"(?im:^(?:[>\s]*){_any(GREETINGS)})[ ](?P<n>{_NAME})(?=\s*[,!:\n])", re.M),
    _needs(["— ", "– "], rf"(?<![\w—])[—–][ ](?P<n>{_NAME})\s*(?=$|\n)", re.M),
    _needs([f" {v}" for v in SAYING], rf"(?<![\w.])(?P<n>{_NAME})[ ]{_any(SAYING)}[ ](?:for|to|me|us|that|so|the|a|an|this|it|about|if|whether|why)\b"),
    _needs([f"{v} " for v in MET], rf"(?i:(?<!\w){_any(MET)})[ ](?:with[ ])?(?P<n>{_FULL})"),
    _needs([f"{t}{end}" for t in TITLES if len(t) > 1 for end in (" ", ".")], rf"(?<![\w.])(?P<n>{_any([t for t in TITLES if t not in ('M', 'Miss')])}\.?[ ]{_CORE})"),
    _needs(["先生", "女士", "小姐", "老师"], rf"(?P<n>{_HAN})(?=先生|女士|小姐|老师)"),
]
_BEFORE_ADDRESS = re.compile(rf"(?:^|[\n.?!。？！]\s?|\s)(?P<n>{_NAME}),?\s(?:Flat[ ]\d+\w?,[ ])?$")
HOME = re.compile(r"(?i:(?:/home|/Users|[a-z]:[\\/]+(?:Users|Documents and Settings)|/mnt/[a-z]/Users|\\\\[\w.\-]+\\(?:home|users))[\\/]+)(?P<n>[^\\/\n\"<>|:*?]+?)(?=[\\/]|$|\n|[ ](?=[a-z]))")
CLIENT = re.compile(rf"[\\/](?:clients?|customers?|patients?|people|persons?|staff|employees?|kunden)[\\/](?P<n>{_NAME})(?=[\\/]|$)", re.I)
_SERVICE = re.compile(r"(?:^|[-_])(?:bot|ci|svc|service|runner|agent|daemon)(?:$|[-_\d])")
_HOMES, _AT_SIGN = ("home", "users", "documents and settings"), re.compile(r"[@＠]|%40|at\s?[\])]")
_FIVE_DIGITS, _DIGIT = re.compile(r"(?:\d[\s.\-()/]{0,3}){5}"), re.compile(r"\d")


def is_person(words: list[str]) -> bool:
    """Whether capitalised words can be a person's name: none of them is a word of roles, groups, machines or grammar."""
    whole = [w for w in words if len(w.strip(".")) > 1]  # initials are letters, whatever words they look like
    return bool(whole) and not any(w.lower().strip(".") in NO_PERSON for w in whole)


def _hide(text: str, start: int, end: int) -> str:
    return text[:start] + "\u0000" * (end - start) + text[end:]


def find_spans(text: str, is_path: bool = False) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the personal data in ``text``, in order of appearance, without overlaps.

    ``is_path`` adds what only directories have: account folders of home directories and client folders.
    """
    spans: list[tuple[str, int, int]] = []
    left, low = text, text.lower()
    holds = lambda needles: any(n in low for n in needles)
    if any(ch in text for ch in "[<$%{"):
        for m in list(PLACEHOLDER.finditer(left)):
            left = _hide(left, *m.span())

    def take(kind: str, start: int, end: int) -> None:
        nonlocal left
        if "\u0000" not in left[start:end]:
            spans.append((kind, start, end))
            left = _hide(left, start, end)

    if _AT_SIGN.search(low):
        for pattern in (EMAIL, EMAIL_PATH):
            for m in pattern.finditer(left):
                if "://" not in left[max(0, m.start() - 12) : m.start()]:
                    take("EMAIL", *m.span())
    # names before numbers: a name may stand next to an address
    if holds(_HOMES):
        for m in HOME.finditer(left):
            account = m["n"].strip()
            lowered = account.lower()
            if account and lowered not in MACHINE_ACCOUNTS and not _SERVICE.search(lowered) and re.search(r"[^\W\d_]{2}", account) and "\u0000" not in account:
                take("NAME", m.start("n"), m.start("n") + len(m["n"].rstrip()))
    if is_path:
        for m in CLIENT.finditer(left):
            take("NAME", *m.span("n"))
    if _DIGIT.search(text):
        for m in ADDRESS.finditer(left):
            take("ADDRESS", *m.span())
            before = None if is_path else _BEFORE_ADDRESS.search(left[max(0, m.start() - 160) : m.start()])
            if before and is_person(before["n"].replace(",", " ").split()) and re.search(r",\s", before.group()):
                shift = max(0, m.start() - 160)
                take("NAME", shift + before.start("n"), shift + before.end("n"))
    for needles, pattern in NAME_RULES:
        if holds(needles):
            for m in pattern.finditer(left):
                start, words = m.start("n"), m["n"].replace(",", " ").split()
                while len(words) > 1 and words[0].lower() in LEADING:
                    start = left.index(words[1], start + len(words.pop(0)))
                if is_person(words):
                    take("NAME", start, m.end("n"))
    if _FIVE_DIGITS.search(text):
        noise = left
        for m in list(NOISE.finditer(noise)):
            noise = _hide(noise, *m.span())
        for kind, pattern in (("ID_NUMBER", ID_NUMBER), ("PHONE", PHONE)):
            for m in pattern.finditer(noise):
                if kind == "PHONE" and not 7 <= sum(ch.isdigit() for ch in m.group()) <= 15:
                    continue
                if "\u0000" not in left[m.start() : m.end()]:
                    take(kind, *m.span())
                    noise = _hide(noise, *m.span())
    return sorted(spans, key=lambda s: s[1])


_SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("value", StringType())])


@pandas_udf(ArrayType(_SPAN))
def spans_udf(text: pd.Series, is_path: pd.Series) -> pd.Series:
    return pd.Series([[(k, s, e, t[s:e]) for k, s, e in find_spans(t, bool(p))] if t else [] for t, p in zip(text, is_path, strict=True)], dtype=object)


#: Not deterministic for the optimizer only: else a filter on the spans would be pushed down and find them a second time.
_spans_once = spans_udf.asNondeterministic()


def detect(tables: dict[str, tuple[DataFrame, str, str, bool]]) -> DataFrame:
    """record_table, record_id, text, spans of every record with personal data.

    ``tables``: name to (DataFrame, id column, text column, whether the text is a path); nothing else is read.  Rows
    delivered again are found again; ``found`` counts them once.  Null ids, null and empty texts hold nothing.
    """
    parts = [
        df.select(F.lit(name).alias("record_table"), F.col(key).cast("string").alias("record_id"), F.col(text).alias("text"), F.lit(is_path).alias("is_path"))
        for name, (df, key, text, is_path) in tables.items()
    ]
    rows = reduce(lambda a, b: a.unionByName(b), [spread(p) for p in parts]).filter(F.col("record_id").isNotNull() & (F.col("text") != ""))
    return rows.withColumn("spans", _spans_once("text", "is_path")).filter("size(spans) > 0").drop("is_path")


def found(detected: DataFrame) -> DataFrame:
    """record_table, record_id, kind: one row for each kind found in a record."""
    return detected.select("record_table", "record_id", F.explode(F.array_distinct(F.col("spans.kind"))).alias("kind")).distinct()


_LABEL = re.compile(r"(?i)^(?:passport|reisepass|passeport|pasaporte|护照)\s*(?:no\.?|nr\.?|number|num\.?|n[°º]|#|号码?)?\s*[:：#]?\s*")
_TRUNK = re.compile(r"\(0\)")


def normalise(kind: str, value: str) -> str:
    """The value as it counts for coreference: spelling variants of one value are equal."""
    text = unicodedata.normalize("NFKC", value)
    if kind == "EMAIL":
        text = re.sub(_AT, "@", re.sub(r"(?i)^mailto:", "", text), flags=re.I)
        return re.sub(_DOT, ".", text, flags=re.I).lower()
    if kind == "PHONE":
        digits = re.sub(r"[^0-9+]", "", _TRUNK.sub("", text))
        return re.sub(r"^00", "+", digits)
    if kind == "ID_NUMBER":
        return re.sub(r"[^0-9A-Z]", "", _LABEL.sub("", text).upper())
    if kind == "NAME":
        text = re.sub(rf"^{_TITLE}", "", text + " ").strip()
        a, comma, b = text.partition(",")
        return " ".join((f"{b} {a}" if comma else text).casefold().split())
    return " ".join(text.casefold().split())


# Names to draw from by script and gender (n: it isn't known), and names that tell a gender.
DRAWN = {
    "latin": {
        "f": "Alma Berit Clara Dunja Edda Freya Gilda Hanna Irma Juno Karin Lotte Mona Nora Olga Paula Runa Stina Thea Vera Wilma Xenia Ylva Zita".split(),
        "m": "Anton Bruno Carl Dario Emil Felix Georg Hugo Ivar Jakob Klaus Leon Magnus Nestor Oskar Pavel Ruben Simon Theo Viktor Willem Xaver Yannis Zeno".split(),
        "n": "Ariel Blake Charlie Devin Eden Finley Gray Harper Indigo Jules Kit Lennox Morgan Noel Oakley Peyton Quinn Robin Sasha Toni Umber Val Winter Zion".split(),
        "family": "Abelmark Borgwyn Corvanne Dahlquist Estervald Fenwright Grauberg Holmquast Ingervold Jarlsby Kestwick Lorimont Mandeville Norbrook Ostermann Pellworth Quistgard Rothwell Sandoval Thornbury Ulvestad Vestergard Wolfhagen Ysengard".split(),
    },
    "cyrillic": {
        "f": "Алина Вера Дарина Злата Инна Карина Лада Мила".split(), "m": "Антон Богдан Виктор Глеб Денис Захар Кирилл Матвей".split(), "n": "Женя Мика Паша Саша Слава Тоня Шура Юля".split(),
        "family": "Белогорск Ветлужан Громовец Добринец Заречник Каменец Лесовик Озерецк".split(),
    },
    "greek": {
        "f": "Αλίκη Δάφνη Ελπίδα Ηρώ Καλλιόπη Λυδία Μυρτώ Ροδάνθη".split(), "m": "Άγγελος Βίκτωρ Γιάννης Θέμης Ίωνας Κίμων Λέανδρος Ορέστης".split(), "n": "Άρτεμις Βάιος Δάμων Ήλιος Ίρις Λητώ Νιόβη Φαίδων".split(),
        "family": "Αμπελάς Βρυώνης Γαλανός Δροσινός Ελατός Καλαμάς Λειβαδάς Πεύκος".split(),
    },
}
GENDERED = {
    "f": "anna maria ruth beatrix ingrid elena sofia julia laura sarah emma lena greta ines ilse leila aiko yuki noor élodie anouk siobhán zanele marta tamsin claire camille agnes helen karen susan linda mary elizabeth jennifer patricia carmen pilar lucía irene olga vera мария анна елена ольга наталья ирина татьяна μαρία ελένη κατερίνα".split(),
    "m": "thomas luca andrea peter paul hans jonas nils mateo dmitri kwame chidi tomás john james robert michael david richard charles joseph daniel mark george kenneth carlos juan josé luis pedro pierre jean jacques klaus jürgen otto иван пётр сергей алексей дмитрий николай γιώργος νίκος δημήτρης".split(),
}
FEMALE_TITLES, MALE_TITLES = "ms mrs miss mme mlle frau sra srta señora doña г-жа".split(), "mr herr m sr señor don г-н".split()
#: Words of an address that stay.
STAYING = {w.lower().strip(".") for w in [*STREETS, *SOFT_STREETS, *FRENCH_STREETS, *SPANISH_STREETS, *OTHER_STREETS, *GERMAN_ENDINGS, *PARTICLES]} | set("flat bis ter quater des les l d au aux del los las y c n nº n° a b am an im in zum zur auf dem unter den hinter dei delle della degli".split())
_SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρστ", "αειου")}
_GIVEN_HAN = "安博晨丹恩芳刚海嘉凯兰明宁平庆瑞思婷文晓雅云泽志佳军丽敏琪然诗涛伟欣阳莹"
_CJK_STREET = re.compile(r"[一-鿿]{2,12}(?=(?:路|街|巷|大道|胡同|弄)\d)")


def script_of(text: str) -> str:
    """latin, cyrillic, greek, han or other, by the first letter."""
    letter = next((ch for ch in text if ch.isalpha()), "a")
    name = unicodedata.name(letter, "")
    return next((s for s in ("latin", "cyrillic", "greek") if name.startswith(s.upper())), "han" if name.startswith("CJK") else "other")


def gender_of(title: str, core: str) -> str:
    """f or m where a title or a given name tells it, else n."""
    title = title.strip(". \t").lower()
    if title in FEMALE_TITLES or title in MALE_TITLES:
        return "f" if title in FEMALE_TITLES else "m"
    first = (core.partition(",")[2].strip() or core).split()
    return next((g for g, names in GENDERED.items() if first and first[0].casefold() in names), "n")


def _stream(key: bytes, *parts: object) -> Iterator[int]:
    """Keyed bytes without end."""
    block = 0
    while True:
        yield from hmac.new(key, "\0".join(map(str, (*parts, block))).encode(), hashlib.sha512).digest()
        block += 1


def permuted(symbols: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of the sequences of these radices: different sequences never come out alike (Feistel rounds over two halves)."""
    half = (len(radices) + 1) // 2

    def pack(values: list[int], sizes: list[int]) -> tuple[int, int]:
        number, size = 0, 1
        for v, r in zip(values, sizes, strict=True):
            number, size = number * r + v, size * r
        return number, size

    def unpack(number: int, sizes: list[int]) -> list[int]:
        out = []
        for r in reversed(sizes):
            number, v = divmod(number, r)
            out.append(v)
        return out[::-1]

    (left, a), (right, b) = pack(symbols[:half], radices[:half]), pack(symbols[half:], radices[half:])
    for n in range(8):
        digest = hmac.new(key, f"{tweak}\0{radices}\0{n}\0{right if n % 2 else left}".encode(), hashlib.sha512).digest()
        if n % 2:
            left = (left + int.from_bytes(digest, "big")) % a
        else:
            right = (right + int.from_bytes(digest, "big")) % b
    return unpack(left, radices[:half]) + unpack(right, radices[half:])


def _renumbered(kind: str, value: str, key: bytes, counter: int) -> str:
    """A number with the characters of its normal form permuted, in its own spelling: digits stay digits, letters letters, a leading zero stays."""
    normal = normalise(kind, value).lstrip("+")
    radices = [26 if ch.isalpha() else 1 if ch == "0" and i == 0 else 9 if i == 0 else 10 for i, ch in enumerate(normal)]
    base = [ord("A") if ch.isalpha() else ord("0") if i or ch == "0" else ord("1") for i, ch in enumerate(normal)]
    symbols = [ord(ch) - b for ch, b in zip(normal, base, strict=True)]
    fresh = iter(chr(b + v) for b, v in zip(base, permuted(symbols, radices, key, f"{kind}\0{counter}"), strict=True))
    label = _LABEL.match(value).end() if kind == "ID_NUMBER" and _LABEL.match(value) else 0
    if kind == "PHONE":
        label = next((m.end() for m in (re.match(r"(?i)(?:tel:)?\D*", value),)), 0)
        label += 2 if value[label : label + 2] == "00" and normalise(kind, value).startswith("+") else 0
    trunk = [m.start() + 1 for m in _TRUNK.finditer(value)] if kind == "PHONE" else []
    changes = lambda i, ch: i >= label and i not in trunk and (ch.isdigit() or (kind == "ID_NUMBER" and ch.isascii() and ch.isalpha()))
    out = []
    for i, ch in enumerate(value):
        new = next(fresh, ch) if changes(i, ch) else ch
        out.append(new.lower() if ch.islower() else new)
    return "".join(out)


def _letters(word: str, stream: Iterator[int]) -> str:
    """Other letters of the same script and case, for scripts without a list of names."""
    out = []
    for ch in word:
        low = ord(ch) & ~31
        near = [chr(c) for c in range(low, low + 64) if unicodedata.category(chr(c)) == unicodedata.category(ch) and unicodedata.name(chr(c), "").split(" ")[0] == unicodedata.name(ch, "").split(" ")[0]]
        out.append(near[next(stream) % len(near)] if ch.isalpha() and near else ch)
    return "".join(out)


def _cased(new: str, like: str) -> str:
    return new.upper() if like.isupper() and len(like) > 1 else new.lower() if like.islower() else new


def _family(script: str, stream: Iterator[int], syllables: int) -> str:
    names, (consonants, vowels) = DRAWN[script]["family"], _SYLLABLES[script]
    return names[next(stream) % len(names)] + "".join(consonants[next(stream) % len(consonants)] + vowels[next(stream) % len(vowels)] for _ in range(syllables))


def _renamed(value: str, stream: Iterator[int], counter: int) -> str:
    """A person's name: title, order, initials, particles, separators and case stay."""
    title = re.match(_TITLE, value)
    core = value[title.end() :] if title else value
    script = script_of(core)
    if script == "han":
        count = max(2, sum(ch.isalpha() for ch in core)) + counter
        return (title.group() if title else "") + CJK_FAMILIES[next(stream) % len(CJK_FAMILIES)] + "".join(_GIVEN_HAN[next(stream) % len(_GIVEN_HAN)] for _ in range(count - 1))
    parts = re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+|[\W_]+", core)
    words = [i for i, p in enumerate(parts) if p[0].isalpha() and p.lower() not in PARTICLES]
    comma = next((i for i, p in enumerate(parts) if "," in p), None)
    # what stands before a comma, else the last word (the only one, with a title or none), is the family name
    family = {i for i in words if i < comma} if comma is not None else set(words[-1:])
    drawn, lasting = DRAWN.get(script), _family(script, stream, 2 + counter) if script in DRAWN else ""
    given = drawn[gender_of(title.group() if title else "", core)] if drawn else []
    givens = [given[next(stream) % len(given)] if given else "" for _ in words]
    out, place = [], 0
    for i, part in enumerate(parts):
        if part[0].isdigit():
            out.append("".join(str(next(stream) % 10) for _ in part))
        elif i not in words:
            out.append(part)
        else:
            new = (lasting if i in family else givens[place]) if drawn else _letters(part, stream) + (_letters(part[:1], stream) * counter if i in family else "")
            place += i not in family
            out.append(_cased(new[:1] if len(part) == 1 else new, part))
    return (title.group() if title else "") + "".join(out)


def _readdressed(value: str, stream: Iterator[int], counter: int) -> str:
    """An address: house numbers and the proper words of the street change, street words, articles and order stay."""
    named = False

    def street(m: re.Match) -> str:
        nonlocal named
        named = True
        return "".join(chr(0x4E00 + (next(stream) * 256 + next(stream)) % 5000) for _ in range(len(m.group()) + counter))

    def word(m: re.Match) -> str:
        nonlocal named
        old = m.group()
        if old.isdigit():
            return str(1 + next(stream) % 9) + "".join(str(next(stream) % 10) for _ in old[1:])
        script = script_of(old)
        ending = next((e for e in sorted(GERMAN_ENDINGS + NORTHERN_ENDINGS, key=len, reverse=True) if old.lower().endswith(e) and len(old) > len(e)), "")
        if old.lower() in STAYING or (len(old) == 1 and old.isascii()) or script == "han":
            return old
        new = _family(script, stream, 0 if named else counter) if script in DRAWN else _letters(old, stream)
        named = True
        return _cased(new + old[len(old) - len(ending) :] if ending else new, old)

    out = re.sub(r"\d+|[^\W\d_]+", word, _CJK_STREET.sub(street, value))
    return out if named else f"{out} {_family('latin', stream, counter)}"


def surrogate(kind: str, value: str, key: bytes, counter: int = 0) -> str:
    """The replacement for a value: same kind, format, script, case and (names) gender; from the keyed hash of its normal form.

    Numbers are permuted, so that different ones never share a replacement; mail addresses, names and streets grow with ``counter``.
    """
    if kind in ("PHONE", "ID_NUMBER"):
        return _renumbered(kind, value, key, counter)
    stream = _stream(key, kind, normalise(kind, value), counter)
    if kind == "NAME":
        return _renamed(value, stream, counter)
    if kind == "ADDRESS":
        return _readdressed(value, stream, counter)
    local = f"{DRAWN['latin']['n'][next(stream) % 24].lower()}.{DRAWN['latin']['family'][next(stream) % 24].lower()}{sum(next(stream) << 8 * i for i in range(3 + counter))}"
    at, mailto = re.search(_AT, value, re.I), re.match(r"(?i)mailto:", value)
    dot = re.search(_DOT, value[at.end() :], re.I) if at else None
    out = f"{mailto.group() if mailto else ''}{local}{at.group() if at else '@'}mail{dot.group() if dot else '.'}example"
    return out.upper() if value.isupper() else out


def _by_value(f: Callable[..., str]):
    @pandas_udf("string")
    def run(kind: pd.Series, value: pd.Series, counter: pd.Series) -> pd.Series:
        return pd.Series([f(k, v, int(c)) for k, v, c in zip(kind, value, counter, strict=True)], dtype=object)

    return run


def surrogate_table(detected: DataFrame, key: bytes, rounds: int = 8) -> DataFrame:
    """kind, value, replacement of every distinct value, distinct normal forms having distinct replacements, none of them a value of the data.

    The collision check looks at the replacement of every spelling.  Normal forms that share one with a smaller normal form, or whose replacement
    is itself found in the data, are derived again with the next counter, until there are none.  An error is raised if ``rounds``
    rounds in a row bring no fewer: the data then hold almost all numbers of some format.
    """
    scratch = Scratch(detected.sparkSession, "surrogates")
    norm = _by_value(lambda k, v, _: normalise(k, v))
    derive = _by_value(lambda k, v, c: surrogate(k, v, key, c))
    target = _by_value(lambda k, v, c: normalise(k, surrogate(k, v, key, c)))

    values = detected.select(F.explode("spans").alias("s")).select("s.kind", "s.value").distinct()
    values = scratch.keep(values.withColumn("normal", norm("kind", "value", F.lit(0))).withColumn("counter", F.lit(0)), "values0")
    real = values.select("kind", F.col("normal").alias("target"), F.lit(True).alias("is_real")).distinct()
    k, fewest, stuck = 0, None, 0
    while True:
        drawn = values.withColumn("target", target("kind", "value", "counter"))
        owners = drawn.groupBy("kind", "target").agg(F.min("normal").alias("keeps"))
        judged = drawn.join(owners, ["kind", "target"]).join(real, ["kind", "target"], "left")
        again = (F.col("keeps") != F.col("normal")) | F.coalesce("is_real", F.lit(False))
        bad = judged.filter(again).select("kind", "normal", F.lit(1).alias("more")).distinct()
        bad, seen = scratch.keep_counted(bad, f"bad{k}", n=F.count(F.lit(1)))
        if not seen["n"]:
            return values.select("kind", "value", derive("kind", "value", "counter").alias("replacement"))
        fewest, stuck = (seen["n"], 0) if fewest is None or seen["n"] < fewest else (fewest, stuck + 1)
        if stuck >= rounds:
            raise ValueError(f"{seen['n']} values still share a replacement after {k + 1} rounds")
        k += 1
        moved = values.join(bad, ["kind", "normal"], "left").withColumn("counter", F.col("counter") + F.coalesce("more", F.lit(0))).select("kind", "value", "normal", "counter")
        values = scratch.keep(moved, f"values{k}")


def replaced(detected: DataFrame, replacements: DataFrame) -> DataFrame:
    """record_table, record_id, kind: one row for each kind of which a record holds a value that is replaced."""
    flat = detected.select("record_table", "record_id", F.explode("spans").alias("s")).select("record_table", "record_id", "s.kind", "s.value").distinct()
    return flat.join(replacements, ["kind", "value"]).select("record_table", "record_id", "kind").distinct()


def redact(detected: DataFrame, replacements: DataFrame | None = None) -> DataFrame:
    """record_table, record_id, text with every span replaced: by ``[KIND]``, or by its surrogate if a table of them is given."""
    if replacements is None:
        pieces = detected.withColumn("swaps", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("by"))))
    else:
        flat = detected.select("record_table", "record_id", "text", F.explode("spans").alias("s")).select("record_table", "record_id", "text", "s.*").join(replacements, ["kind", "value"])
        pieces = flat.groupBy("record_table", "record_id", "text").agg(F.array_sort(F.collect_set(F.struct("start", "end", F.col("replacement").alias("by")))).alias("swaps"))
    return pieces.select("record_table", "record_id", _spliced("text", "swaps").alias("text")).distinct()


def _spliced(text: str, swaps: str) -> Column:
    """``text`` with the character ranges of ``swaps`` (sorted, disjoint) replaced."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    part = lambda at, n: F.col(text).substr(at + 1, n)
    step = lambda acc, s: F.struct(F.concat(acc["out"], part(acc["at"], s["start"] - acc["at"]), s["by"]).alias("out"), s["end"].alias("at"))
    return F.aggregate(swaps, start, step, lambda acc: F.concat(acc["out"], part(acc["at"], F.length(text))))
