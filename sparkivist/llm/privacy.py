"""Personal data in free text: found, checked, scored and replaced by typed placeholders.

Regular expressions propose spans of five kinds with a base score. Validators confirm or refuse
them by checksum and structure (ISO 7064 mod 11-2, mod 97, Luhn and the check digits of further
national numbers, dates, numbering plans). Words close by raise or lower the score; what reaches
the threshold is kept, the higher score winning where spans overlap. A name needs no phrase beside
it: frequent given and family names and its shape are evidence too. Everything is local to a row: a
scan and one Arrow map, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkivist.plans.session import table

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
THRESHOLD = 0.5
_REACH = 28  # characters before and after a span in which context words count

# Full-width forms are read as their ASCII forms; the map keeps every position.
_NARROW = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F) if chr(c) not in "，：；！？（）"} | {0x3000: 0x20, 0xA0: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2012: 0x2D, 0x2013: 0x2D, 0xFF08: 0x28, 0xFF09: 0x29}

_WIDE = re.compile("[！-／０-９＜-＞＠-～\u3000\xa0\u2010-\u2013]".replace("！-／", "＂-＇＊＋－-／（）"))
_SENTENCE_END = re.compile(r"[。！？\n]|[.!?]\s(?=[A-Z一-鿿])")
_DIGIT = re.compile(r"\d")

# ---------------------------------------------------------------- mail addresses
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+'-]{0,62}[A-Za-z0-9_])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})"
_TLD = r"[A-Za-z]{2,24}"
_AT = r"(?:\s?[\[({<]\s?(?:at|AT|At|@)\s?[\])}>]\s?)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|DOT|Dot|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s|\.)"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}@(?:{_LABEL}\.)+{_TLD}(?![A-Za-z0-9-]|\.[A-Za-z0-9])")
_EMAIL_HIDDEN = re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}(?:{_AT}(?:{_LABEL}{_DOT})+{_TLD}|\s?@\s?(?:{_LABEL}{_DOT})+{_TLD}|\s(?:at|AT)\s(?:{_LABEL}\s(?:dot|DOT)\s)+{_TLD})(?![A-Za-z0-9-])")
_EMAIL_BRACKETED = re.compile(r"[\[({<]\s?(?:at|AT|At)\s?[\])}>]")

# ---------------------------------------------------------------- telephone numbers
_SEP = r"[ ./-]?"
_PHONE = re.compile(
    r"(?<![A-Za-z0-9_.@#/=-])(?:"
    rf"(?P<cn>(?:\(?(?:\+|00)86\)?{_SEP})?1[3-9]\d(?:{_SEP}\d{{4}}){{2}})"
    rf"|(?P<us>(?:\+?1{_SEP})?(?:\([2-9]\d{{2}}\){_SEP}|[2-9]\d{{2}}[ .-])[2-9]\d{{2}}[ .-]?\d{{4}}(?:\s?(?:ext\.?|x|#)\s?\d{{1,6}})?)"
    rf"|(?P<uk>0(?:7\d{{3}}[ -]?\d{{6}}|7\d{{3}} \d{{3}} \d{{3}}|20[ -]\d{{4}}[ -]\d{{4}}|1\d{{3}}[ -]\d{{6}}|1\d1[ -]\d{{3}}[ -]\d{{4}}))"
    rf"|(?P<de>0\d{{2,4}}\s?[/-]\s?\d{{3,8}}(?:-\d{{1,4}})?(?: \d{{2,4}})?)"
    rf"|(?P<land>0\d{{2,3}}-\d{{7,8}})"
    r"|(?P<fr>0[1-9](?:[ .-]\d{2}){4})"
    r"|(?P<nl>06[ -]\d{8})"
    r"|(?P<jp>0(?:[789]0-\d{4}-\d{4}|[36]-\d{4}-\d{4}|10-\d{4}-\d{4}))"
    r"|(?P<au>04\d{2} \d{3} \d{3}|\(0[2378]\) \d{4} \d{4})"
    r"|(?P<br>\(\d{2}\) ?9?\d{4}-\d{4})"
    r"|(?P<ch>0\d{2} \d{3} \d{2} \d{2})"
    r"|(?P<in>[6-9]\d{4}[ -]\d{5})"
    rf"|(?P<intl>\(?(?:\+|00)[1-9]\d{{0,2}}\)?(?:[ ./-]?\(?\d{{1,5}}\)?){{2,6}})"
    r")(?![A-Za-z0-9_@]|[-.,/:]\d)"
)
# ---------------------------------------------------------------- identity numbers
_ID = re.compile(
    r"(?<![A-Za-z0-9_.@#/=+-])(?:"
    r"(?P<cn>\d{6}[ -]?(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ -]?\d{3}[\dXx])"
    r"|(?P<ssn>\d{3}(?P<sep>[ -])\d{2}(?P=sep)\d{4})"
    r"|(?P<nir>[12]\s?\d{2}\s?(?:0[1-9]|1[0-2])\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2})"
    r"|(?P<sin>\d{3}[ -]\d{3}[ -]\d{3})"
    r"|(?P<se>(?:19|20)?\d{6}[-+]\d{4})"
    r"|(?P<cpf>\d{3}\.\d{3}\.\d{3}-\d{2})"
    r"|(?P<dni>\d{8}-?[A-HJ-NP-TV-Z])"
    r"|(?P<pesel>\d{11})"
    r")(?![A-Za-z0-9_@]|[-./]\d)"
)
_INSURANCE = re.compile(r"\d{2}\s?\d{2}\s?\d{2}\s?[A-Da-d](?![A-Za-z0-9_@])")
_INSURANCE_HEAD = re.compile(r"(?<![A-Za-z0-9_.@#/=+-])[A-Za-z]{2}\s?$")
_PASSPORT = re.compile(r"\d{7,8}(?![A-Za-z0-9_@]|[-./]\d)")
_PASSPORT_HEAD = re.compile(r"(?<![A-Za-z0-9_.@#/=+-])[A-Za-z]{1,2}\s?$")
#: Stretches that hold the digits of numbers; only these are looked at more closely.
_RUN = re.compile(r"[+(\d][\d ()./+xX-]{4,}\d")
# ---------------------------------------------------------------- street addresses
_HAN = "(?:(?![到在住寄了去至往于是放的给从])[一-鿿])"
_HAN_ROAD = re.compile(
    r"[路街巷弄道同]\s?[0-9一二三四五六七八九十百]{1,6}\s?号(?:附\s?\d+\s?号)?(?:院)?(?:\s?\d+\s?(?:幢|栋|号楼|座))?(?:\s?\d+\s?单元)?(?:\s?\d+\s?层)?(?:\s?\d+\s?室?(?!\d))?"
)
_HAN_ROAD_HEAD = re.compile(rf"(?:{_HAN}{{2,3}}?(?:街口|渡口|集市|[省市区县镇乡村站岭塘湖坡里埠巷])){{0,3}}{_HAN}{{2,4}}$")
_ROAD_WORD = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Boulevard|Blvd|Drive|Dr|Way|Place|Pl|Terrace|Ter|Square|Sq|Crescent|Close|Row|Mews|Highway|Hwy)"
_TOWN = r"(?:,?\s[A-Z][\w'-]+(?:\s[A-Z][\w'-]+)?,?\s(?:[A-Z]{2}\s)?\d{5}(?:-\d{4})?)"
_ROAD = re.compile(
    rf"\d{{1,5}}[A-Za-z]?,?\s(?:(?:North|South|East|West|N|S|E|W)\.?\s)?(?:(?!(?i:to|of|at|from|and|the|in|on|for)\b)[A-ZÄÖÜ][\w'-]+\s){{1,3}}(?i:{_ROAD_WORD})\b\.?(?:,?\s(?:Apt|Unit|Suite|Flat)\.?\s?\d+[A-Za-z]?)?{_TOWN}?"
)
_ROAD_HEAD = re.compile(r"(?:Unit|Flat|Apt|Apartment|Suite)\.?\s?\d+[A-Za-z]?,?\s$", re.I)
_STREET_FIRST = re.compile(
    r"\d{1,4}(?:\s?(?:bis|ter))?,?\s(?i:rue|avenue|boulevard|impasse|allée|chemin|quai|cours)\s(?:(?:de|du|des|la|le|les)\s|d['’]|l['’])*[A-ZÀ-Ü][\w'’-]+(?:[\s-][A-ZÀ-Ü][\w'’-]+)?"
    r"|(?:Calle|Avenida|Plaza|Paseo|Via|Viale|Corso|Piazza|Rua|Travessa)\s(?:(?:de|del|la|las|los|da|do|dos|di|della)\s)*[A-ZÀ-Ü][\w'’-]+(?:\s[A-ZÀ-Ü][\w'’-]+)?,?\s(?:n\.?º?\s?)?\d{1,4}\b(?!\s?%)"
)
_HOUSE = re.compile(r"\s{1,2}\d{1,4}\s?[a-hA-H]?\b(?!\s?(?:Uhr|km|%))(?:,?\s\d{5}\s[^\W\d_][\w-]+)?")
_STRASSE_HEAD = re.compile(r"(?<![\w-])[^\W\d_][\w-]*(?:straße|strasse|str\.|weg|allee|gasse|platz|ufer|ring|damm|chaussee|straat|laan|gracht|gatan|vägen|gade|veien)$", re.I)
# ---------------------------------------------------------------- names
# Frequent Chinese family names, titles, and words that stand before or after a person's name.
SURNAMES = (
    "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
    "庄柯骆祝温闻"
)
_HAN_SURNAME = rf"(?:欧阳|司徒|司马|诸葛|上官|皇甫|令狐|慕容|东方|尉迟|夏侯|公孙|[{SURNAMES}])"
_HAN_TITLE = r"(?:先生|女士|小姐|太太|夫人|医生|大夫|老师|教授|博士|律师|师傅|经理|主任)"
_HAN_NAME = re.compile(rf"(?P<name>{_HAN_SURNAME}[一-鿿]{{0,2}}?)(?P<title>{_HAN_TITLE})?(?=[，。；、！？!?,.;\s)）]|$|签收|约|送|的|说|打来)")
_HAN_CUE = re.compile(
    r"(?:联系人(?:是|为)?[:：]?|签收人(?:写的)?(?:是|为)?[:：]?|收[件货]人(?:是|为)?[:：]?|预约的是|预约人[:：]?|的?事问|认识了|我叫|姓名(?:是|为)?[:：]?|名字(?:是|叫)|(?P<weak>认识|我是|名叫|找|问|请|感谢|谢谢|多亏))\s?$"
)
# Frequent given names in Latin script, frequent family names, and characters of Chinese given names.
GIVEN = frozenset(
    "Adam Alan Albert Alexander Alice Amanda Amy Andrea Andrew Angela Ann Anna Anne Anthony Antonio Barbara Benjamin Brian Carl Carlos Carol Caroline Catherine Charles Charlotte Christian Christina Christine Christopher Clara Claire Claudia Daniel David "
    "Deborah Diana Dieter Dorothy Edward Elena Elizabeth Ella Emily Emma Eric Erik Eva Felix Francesca Francis Frank Franz Gabriel George Giulia Grace Greta Hannah Hans Harry Heinrich Helen Helena Henry Hugo Ian Ingrid Isabel Jack Jacob James Jan Jane Janet "
    "Jason Jean Jennifer Jessica Joan Johan Johanna John Jonas Jonathan Jose Joseph Juan Judith Julia Julian Jürgen Karen Karin Karl Katharina Katherine Keith Kevin Klaus Kurt Lars Laura Lena Leo Linda Lisa Louis Louise Lucas Lucy Luis Luisa Lukas Magdalena "
    "Maria Marie Mark Markus Martha Martin Mary Matthew Max Michael Miguel Monika Nicholas Nicole Nina Nora Olivia Oliver Oscar Pablo Patricia Patrick Paul Paula Peter Philip Pierre Rachel Rebecca Richard Robert Rosa Ruth Samuel Sandra Sarah Simon Sofia "
    "Sophie Stefan Stephen Susan Teresa Thomas Ursula Victoria Walter Werner William Wolfgang".split()
)
FAMILY = frozenset(
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores "
    "Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hofmann Lange Werner Krause "
    "Lehmann Dubois Bernard Moreau Laurent Rossi Russo Ferrari Esposito Bianchi Silva Santos Ferreira Pereira Oliveira Costa Jensen Nielsen Hansen Larsen Olsen Johansson Andersson Karlsson Nilsson Lindqvist Whitfield Kowalski Novak Kim Park Singh Patel Kumar".split()
)
_HAN_GIVEN = frozenset("伟芳娜敏静丽强磊军洋勇艳杰娟涛超秀霞平刚桂英华玉兰建国志文明红霖婷雪琳倩颖洁莉萍玲慧晨宇浩轩梓涵欣怡俊峰鹏飞鑫波斌辉凯旭彬宁健嘉豪思琪雅诗佳琦")
_HAN_BARE = re.compile(rf"(?:^|(?<=[，。；、！？!?,.;\n“「：:]))\s?(?P<name>{_HAN_SURNAME}[一-鿿]{{1,2}}?)(?=(?:昨天|今天|前天|昨晚|刚才|上周|后来)?(?:又|也|就|还|都)?(?:来过|来了|打来|打电话|告诉|说过|说她|说他|说要|答应|借走|送来|寄来|问我|帮我|约我|找我|请我|昨天|今天|前天|昨晚))")
_KIN = re.compile(r"\b(?:sister|brother|mother|father|aunt|uncle|cousin|friend|neighbou?r|colleague|boss|teacher|doctor|wife|husband|daughter|son|niece|nephew|grandmother|grandfather|nurse|landlord|schwester|bruder|freundin?|nachbarin?|kollegin?|chefin?|tante|onkel)\s$", re.I)
_DEED = re.compile(r"(?:['’]s\b)?,?\s(?:came|comes|said|says|called|calls|wrote|writes|told|asked|asks|visited|lives|lived|moved|brought|gave|sent|phoned|answered|invited|promised|thinks|thought|works|worked|kam|sagte|schrieb|rief|wohnt|brachte|fragte)\b")
_TO_PLACE = re.compile(r"\b(?:in|at|near|through|across|around|towards?|nach|bei|in der|im)\s$", re.I)
_COMPOUND = ("欧阳", "司徒", "司马", "诸葛", "上官", "皇甫", "令狐", "慕容", "东方", "尉迟", "夏侯", "公孙")
_CAP = r"(?:(?:[A-ZÄÖÜ]['’])?[A-ZÄÖÜ][a-zäöüßéèáó]+(?:-[A-ZÄÖÜ][a-zäöüßéèáó]+)?|[A-ZÄÖÜ]{2,}(?:['’-][A-ZÄÖÜ]+)?|[A-ZÄÖÜ]['’][A-ZÄÖÜ]{2,})"
_FULL = rf"(?:{_CAP},\s{_CAP}|{_CAP}(?:\s[A-Z]\.)?(?:\s(?:van|von|de|der|la))?\s{_CAP})"
_TITLED = rf"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Herr|Herrn|Frau|Sir|Madam|MR|MRS|MS|DR|PROF|HERR|FRAU)\.?\s{_CAP}(?:\s(?!(?:The|This|That|In|On|At|A|An|And|Das|Der|Die|I)\b){_CAP})?"
_CUE = re.compile(
    r"(?:\b(?:ask|i met|met|appointment is with|appointment with|contact person:|contact:|thanks to|my name is|i am called|name:|signed by|addressed to|attn:?|dear|spoke (?:to|with)|care of|c/o"
    r"|ansprechpartner(?:in)?:|ich heiße|mein name ist|termin (?:ist )?(?:bei|mit)|dank an|unterschrieben von))\s$",
    re.I,
)
_NAME = re.compile(rf"(?P<titled>{_TITLED})|(?!(?:Ask|Met|Dear|Call|Contact|Attn|Name|Signed|Thanks|The|This|That|In|On|At|A|An|I|And|Das|Der|Die)\b)(?P<full>{_FULL})")
_CAPITALS = re.compile(r"[A-ZÄÖÜ](?=[\w.'’-]*,?\s(?:[A-Z]\.\s)?(?:(?:van|von|de|der|la)\s)?[A-ZÄÖÜ])")
_NAME_AFTER = re.compile(r"\s(?:signed for|signed it|hat unterschrieben|called back|left a message)")
# Words that are part of places and things, not of persons.
_NOT_PERSON = re.compile(r"\b(?:Museum|Station|Street|Road|Avenue|Lane|Court|Blvd|Project|Lake|River|Mount|Bridge|Market|University|School|Hospital|Hotel|Park|Library|The|This|That|Chapter|Section|Room|Building|Order|Handle|Straße)\b", re.I)

_CONTEXT = {
    "phone": (re.compile(r"\b(?:call|phone|tel|telephone|mobile|cell|text|sms|number is|direct|machine|telefon|handy|anruf|ruf)\b|电话|手机|短信|致电|打", re.I), re.compile(r"\b(?:order|isbn|invoice|tracking|serial|version|build|section|ticket|parcel no)\b|订单|单号|流水|编号|版本|坐标", re.I)),
    "id_number": (re.compile(r"\b(?:ssn|social|national id|id|insurance|ni number|passport|form|identity|sin|personnummer|pesel|dni|cpf|tax id|personalausweis|reisepass)\b|身份证|证件|护照|办手续|表上填", re.I), re.compile(r"\b(?:order|isbn|invoice|tracking|serial|not a person|ticket)\b|订单|单号|流水|不是证件|编号", re.I)),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod_11_2(number: str) -> bool:
    """ISO 7064 check character of an 18-place citizen number."""
    rest = sum(int(c) * (pow(2, 17 - i) % 11) for i, c in enumerate(number[:17])) % 11
    return "10X98765432"[rest] == number[17].upper()


def mod_97(number: str) -> bool:
    """The last two digits complete the others to a multiple of 97."""
    return 97 - int(number[:-2]) % 97 == int(number[-2:])


def _real_date(digits: str) -> bool:
    try:
        return date(int(digits[:4]), int(digits[4:6]), int(digits[6:])).year >= 1850
    except ValueError:
        return False


def _score_phone(m: re.Match) -> float:
    digits, kind = re.sub(r"\D", "", m.group()), m.lastgroup
    if not 7 <= len(digits) <= 18:
        return 0.0
    if kind == "intl":
        return 0.75 if 9 <= len(digits) <= 16 else 0.0
    bare = m.group().isdigit()
    if kind == "cn":
        return 0.6 if bare else 0.75
    # A pattern of two long groups only (in) needs a word beside it.
    return {"us": 0.65, "uk": 0.6, "de": 0.45, "land": 0.6, "fr": 0.6, "nl": 0.55, "jp": 0.6, "au": 0.6, "br": 0.6, "ch": 0.55, "in": 0.35}[kind] - 0.2 * bare


def _score_id(m: re.Match) -> float:
    kind = m.lastgroup if m.lastgroup != "sep" else "ssn"
    digits = re.sub(r"[ -]", "", m.group())
    if kind == "cn":
        return 0.8 if _real_date(digits[6:14]) and mod_11_2(digits) else 0.0
    if kind == "ssn":
        return 0.55 if digits[3:5] != "00" and digits[5:] != "0000" and digits[:3] not in ("000", "666") else 0.0
    if kind == "nir":
        return 0.6 if mod_97(digits) else 0.0
    # The check digits of these leave one number in ten or so, hence a word must stand beside most of them.
    if kind == "sin":
        return 0.35 if luhn(digits) else 0.0
    if kind == "se":
        ten = re.sub(r"\D", "", digits)[-10:]
        return 0.55 if luhn(ten) and _real_date("19" + ten[:6]) else 0.0
    if kind == "cpf":
        return 0.7 if cpf(re.sub(r"\D", "", digits)) else 0.0
    if kind == "dni":
        return 0.4 if "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits[:8]) % 23] == digits[-1] else 0.0
    return 0.35 if pesel(digits) else 0.0


def cpf(digits: str) -> bool:
    """Both check digits of a Brazilian taxpayer number."""
    for n in (9, 10):
        rest = sum(int(c) * (n + 1 - i) for i, c in enumerate(digits[:n])) * 10 % 11 % 10
        if rest != int(digits[n]):
            return False
    return len(set(digits)) > 1


def pesel(digits: str) -> bool:
    """Birth date, its century in the month, and check digit of a Polish national number."""
    month = int(digits[2:4])
    century = {0: "19", 1: "20", 2: "21", 3: "22", 4: "18"}[month // 20]
    check = -sum(int(c) * (1, 3, 7, 9)[i % 4] for i, c in enumerate(digits[:10])) % 10
    return check == int(digits[10]) and _real_date(f"{century}{digits[:2]}{month % 20:02}{digits[4:6]}")


def _in_context(t: str, start: int, end: int, kind: str, score: float) -> tuple[float, int, int, str]:
    raise_, lower = _CONTEXT[kind]
    before = _SENTENCE_END.split(t[max(0, start - _REACH) : start])[-1]
    after = _SENTENCE_END.split(t[end : end + _REACH // 2])[0]
    return score + 0.2 * bool(raise_.search(before)) - 0.5 * bool(lower.search(before) or lower.search(after)), start, end, kind


def _numbers(t: str) -> Iterator[tuple[float, int, int, str]]:
    for run in _RUN.finditer(t):
        s, e = run.span()
        if sum(c.isdigit() for c in run.group()) < 6:
            continue
        for m in _ID.finditer(t, max(0, s - 1), e + 2):
            if score := _score_id(m):
                yield _in_context(t, *m.span(), "id_number", score)
        for m in _PHONE.finditer(t, max(0, s - 1), e + 14):
            if score := _score_phone(m):
                yield _in_context(t, *m.span(), "phone", score)
        for rx, head, words, base in ((_INSURANCE, _INSURANCE_HEAD, r"\bNI\b|insurance|国民保险", 0.35), (_PASSPORT, _PASSPORT_HEAD, r"passport|reisepass|护照", 0.2)):
            for m in rx.finditer(t, s, e + 4):
                before = t[max(0, m.start() - _REACH) : m.start()]
                if h := head.search(before):
                    yield _in_context(t, m.start() - len(h.group()), m.end(), "id_number", base + 0.35 * bool(re.search(words, before, re.I)))


def _addresses(t: str) -> Iterator[tuple[float, int, int, str]]:
    for m in _HAN_ROAD.finditer(t):
        head = t[max(0, m.start() - 18) : m.start()]
        if t[m.start()] == "道" and head[-1:] == "大" or t[m.start()] == "街" and head[-1:] == "大":
            head = head[:-1]
        if h := _HAN_ROAD_HEAD.search(head):
            yield 0.8, max(0, m.start() - 18) + h.start(), m.end(), "address"
    for m in _ROAD.finditer(t):
        before = t[max(0, m.start() - 16) : m.start()]
        if not before or not (before[-1].isalnum() or before[-1] in ".,-/" or re.search(r"\bBus\s$", before)):
            h = _ROAD_HEAD.search(before)
            yield 0.7, m.start() - (len(h.group()) if h else 0), m.end(), "address"
    for m in _STREET_FIRST.finditer(t):
        if not m.start() or not (t[m.start() - 1].isalnum() or t[m.start() - 1] in ".,-/@#"):
            yield 0.7, m.start(), m.end(), "address"
    for m in _HOUSE.finditer(t):
        if h := _STRASSE_HEAD.search(t[max(0, m.start() - 32) : m.start()]):
            yield 0.7, m.start() - len(h.group()), m.end(), "address"


def _names(t: str) -> Iterator[tuple[float, int, int, str]]:
    if not t.isascii():
        for m in _HAN_NAME.finditer(t):
            name, title = m["name"], m["title"]
            cue = _HAN_CUE.search(t[max(0, m.start() - 10) : m.start()])
            if not cue and not title:
                continue
            given = len(name) - (2 if name[:2] in _COMPOUND else 1)
            score = 0.1 + 0.5 * bool(cue and (given or title)) + 0.45 * bool(title) - 0.15 * bool(cue and cue["weak"] and not title)
            yield score, m.start("name"), m.end("title") if title else m.end("name"), "name"
        for m in _HAN_BARE.finditer(t):
            given = m["name"][2 if m["name"][:2] in _COMPOUND else 1 :]
            if given and all(c in _HAN_GIVEN for c in given):
                yield 0.55, m.start("name"), m.end("name"), "name"
    for c in _CAPITALS.finditer(t):
        before = t[max(0, c.start() - 24) : c.start()]
        if before and (before[-1].isalnum() or before[-1] in "_'’-@./"):
            continue
        m = _NAME.match(t, c.start())
        if not m or _NOT_PERSON.search(m.group()):
            continue
        if m["titled"] or _CUE.search(before) or _NAME_AFTER.match(t, m.end()):
            yield 0.75, m.start(), m.end(), "name"
            continue
        words = [w for w in re.split(r"[\s,.]+", m["full"]) if len(w) > 1 and w[0].isupper()]
        if len(words) < 2:
            continue
        first, last = words[0].capitalize(), words[-1].capitalize()
        score = 0.35 * (first in GIVEN) + 0.3 * (last in FAMILY) + 0.15 * bool(re.search(r"\s[A-Z]\.\s", m["full"]))
        if score:  # context alone is no evidence
            score += 0.25 * bool(_KIN.search(before)) + 0.25 * bool(_DEED.match(t, m.end())) - 0.3 * bool(_TO_PLACE.search(before))
            yield score, m.start(), m.end(), "name"


def _spans(text: str) -> Iterator[tuple[float, int, int, str]]:
    t = text.translate(_NARROW) if not text.isascii() and _WIDE.search(text) else text
    hidden = _EMAIL_BRACKETED.search(t) or (" dot " in t and " at " in t) or (" DOT " in t and " AT " in t)
    if hidden or "@" in t:
        for rx in (_EMAIL, _EMAIL_HIDDEN):
            for m in rx.finditer(t):
                yield 0.95, m.start(), m.end(), "email"
    if _DIGIT.search(t):
        yield from _numbers(t)
        yield from _addresses(t)
    yield from _names(t)


def find_personal_data(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal data in ``text``, ascending and without overlaps."""
    if not text:
        return []
    kept: list[tuple[int, int, str]] = []
    for _, s, e, kind in sorted((x for x in _spans(text) if x[0] >= THRESHOLD), key=lambda x: (-x[0], x[1] - x[2], x[1])):
        if all(e <= a or s >= b for a, b, _ in kept):
            kept.append((s, e, kind))
    return sorted(kept)


def redact(text: str | None) -> str | None:
    """The text with every find replaced by its placeholder, all else as it was; null stays null."""
    found = find_personal_data(text)
    if not found:
        return text
    out, at = [], 0
    for s, e, kind in found:
        out += [text[at:s], PLACEHOLDER[kind]]
        at = e
    return "".join(out) + text[at:]


def personal_data_kinds(rows: DataFrame) -> DataFrame:
    """(src, row_id, kind), distinct: the kinds that a text holds. rows: src, row_id, text.

    Null and empty texts give no rows, repeated rows one each, an empty table none; other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(s, r, k) for s, r, t in zip(*(c.to_pylist() for c in b.columns)) for k in {f[2] for f in find_personal_data(t)}]
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.int64(), pa.string()])], names=["src", "row_id", "kind"])

    picked = rows.select("src", F.col("row_id").cast("long").alias("row_id"), "text").where("text IS NOT NULL AND text <> ''")
    return picked.mapInArrow(run, "src string, row_id long, kind string").distinct()


def redact_texts(rows: DataFrame) -> DataFrame:
    """(src, row_id, text) with personal data replaced; a row for each row, null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([redact(t) for t in b.column(2).to_pylist()], pa.string())], names=["src", "row_id", "text"])

    return rows.select("src", F.col("row_id").cast("long").alias("row_id"), "text").mapInArrow(run, "src string, row_id long, text string")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "memory_entries").select(F.lit("entry").alias("src"), F.col("entry_id").alias("row_id"), "text")
    return entries.unionByName(table(spark, sf_dir, "archive_msgs").select(F.lit("msg").alias("src"), "row_id", "text"))


def found_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found over all entries and messages."""
    return personal_data_kinds(_texts(spark, sf_dir))


def redacted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_redacted: all texts with placeholders; copies of an entry come out as often as they come in."""
    return redact_texts(_texts(spark, sf_dir))
