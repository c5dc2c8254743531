"""Places in texts: the locality of a notice from ordered patterns, address candidates with their hints, and noise on pages.

Patterns find the same without their look-aheads, so that a statement in SQL can use them. Candidates are tried
in order and the next pattern is only evaluated where the ones before gave nothing useful.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from opalyx.functions import rules
from opalyx.functions.text import WS, bind, even, fold, located, match_text, or_null, window

# --- localities ----------------------------------------------------------------------------------
# Words that rule a locality out.
AUTHORITY_NOISE = "authority|cabildo|council|department|direktion|office|regierung|toimiala"
INSTITUTION_NOISE = "banner|campus|center|centre|community|hospital|library|newsletter|plant|project|school|site|stadium|station|wearch"
WORD_NOISE = r"abschnitt|anlagengruppe|banner|contabilit[aà]|coordinamento|cre|cse|detailplan(?:ung)?|direzione|freianlagen|hoai|iark|investimento|lark|lavori|newsletter|optional(?:e)?|phase\s+candidature|regolare\s+esecuzione|vergabenummer"
URL_NOISE = r"https?://|www\.|[a-z0-9-]+\.(?:com|org|net|eu|gov|edu|it|fr|de|es|pt|cn|nz|no|ch|ca)\b"
# What streets begin and end with.
STREET_PREFIXES = r"c/|c\.|via|viale|piazza|piazzale|corso|largo|vicolo|lungomare|strada|street|road|drive|lane|way|boulevard|avenue|avenida|avda\.?|av\.|rue|route|allee|gasse|platz|strasse|straße|calle|camino|carretera|ruta|plaza|paseo|ronda|rua|travessa|estrada|pra[çc]a|cal[çc]ada|rotunda|laan|plein|gracht|kade|singel|dreef|tie|katu|kuja|polku|ul\.?|ulica|ulice|aleja|al\.?|bd\.?|bulevard(?:ul)?|bulvar|bulevar|str\.?|calea|sos\.?|șos\.?|ул\.?"
STREET_ENDS = r"straat|laan|plein|gracht|kade|singel|dreef|gade|gata|gatan|gate|torv|torget|plass|plassen|vei|veien|veg|vegen|v[aä]g|v[aä]gen|weg|tie|katu|kuja|polku|cesta|ulica|n[aá]m[ěe]st[ií]|trg|utca"
# What an authority's name says before and after its place, and what follows a place in a title.
BEFORE_PLACE = r"gemeindeverwaltung|gemeinde|commune de|commune d['’]|mairie de|mairie d['’]|ville de|city of|municipality of|munic[ií]pio do|munic[ií]pio de|gemeente|stad\s+|ayuntamiento de|municipio de|comune(?: di)?|citt[aà] di"
BEFORE_PROVINCE = r"provincia di|province of|citt[aà] metropolitana di"
BEFORE_TOWN = r"gmina\s+miasto|miasto|m[eě]sto|obec|grad|v[aá]ros|obshtina"
AFTER_PLACE, AFTER_TOWN = "kommune|kommun|kaupunki", r"miasto|m[eě]sto|obec|gmina|grad|v[aá]ros|obshtina"
AFTER_DASH = r"chemin|rue|route|avenue|avenues|boulevard|all[eé]e|impasse|quai|parvis|esplanade|zac|zap|zone\s+d['’](?:am[eé]nagement|activit[eé]s?)|groupe\s+scolaire|coll[eè]ge|lyc[eé]e|gymnase|mus[eé]e|palais|centre\s+d['’]intervention|complexe|site"
# Units of administration in Han script, and tails that name a site.
HAN_UNITS, HAN_SITES = "市|县|镇|乡|街道|新区|开发区|自治州|自治县", "片区|街区|地块|小区|校区|院区|园区|基地"

# Forms of places in titles, each with the place as its first group.
HAN_LEAD = rf"^(?:\d{{4}}年)?((?:[\p{{IsHan}}]{{1,12}}(?:{HAN_UNITS}|区)){{1,4}})"
BEFORE_ADDRESS = r",\s*([^,\d.;][^,.;]{1,79})\s*,\s*([^,.;]{1,120})\s*$"
BEFORE_TAIL = r",\s*([^,\d.;][^,.;]{1,79})\s*,\s*(?:z|with|con|w|v|u|em|en|nel|in|na|no)\b"
AFTER_COMMA = r",\s*(?:\d{4,5}\s+)?([^,\d.;][^,.;]{1,79})\s*$"
AFTER_PREPOSITION = r"\b(?:a|à|au|aux|in|en|em|nel|nella|na|no|w|v|u|sur|sous|l[eè]s)\s+([^,.;()]{2,80})(?:\s*(?:\((?:[A-Z]{2}|\d{2,5})\)|\d{2,5})?\s*)$"
MUNICIPAL_TERM = r"\bt[eé]rmino municipal de\s+(.+?)(?:\s+de la provincia|\s*[.;,]|$)"

_END = r"(?:\s+v/.*|\s*\(|\s+-|$)"
_I = "(?iuU)"


def _group(c: Column, pattern: str) -> Column:
    """The first group of the first match, null where there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def _trimmed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^[\s,;:]+|[\s,;:]+$", ""), r"\s+", " "))


def _segments(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), _trimmed), lambda s: s != "")


def tidy_place(c: Column) -> Column:
    """A place's name as shown: the last part after an authority or a long description, plain quotes and dashes, no province code, no preposition."""

    def last(s: Column) -> Column:
        lead, tail = F.slice(s, 1, F.size(s) - 1), F.try_element_at(s, F.lit(-1))
        words = F.size(F.filter(F.split(F.regexp_replace(fold(tail), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != ""))
        noisy = F.array_join(lead, ", ").rlike(rf"{_I}\b(?:{AUTHORITY_NOISE})\b") | F.exists(lead, lambda x: F.size(F.split(x, r"\s+")) > 4)
        return F.when((F.size(s) >= 2) & words.between(1, 4) & noisy, tail)

    chosen = F.coalesce(bind(_segments(c), lambda s: F.when(F.size(s) >= 2, last(s))), c)
    plain = F.regexp_replace(F.translate(chosen, "“”‘’–—", "\"\"''--"), "^[\"']+|[\"']+$", "")
    bare = F.regexp_replace(_trimmed(plain), r"\s*\([A-Z]{2}\)\s*$", "")
    return F.regexp_replace(bare, rf"{_I}^(?:at|au|aux|em|en|im|in|na|nel|nella|no|sur|te|v|w|u|à)\s+", "")


def address_like(c: Column) -> Column:
    prefixed = rf"{_I}^(?:(?:en|in|nel|nella|a|at|sur|na|no|em|w|v|u)\s+)?(?:{STREET_PREFIXES})(?![\p{{L}}\p{{N}}])"
    ended = rf"{_I}\b(?:[\p{{L}}\p{{N}}.'’/-]+\s+)?[\p{{L}}\p{{N}}.'’/-]+(?:{STREET_ENDS})\s+\d[\p{{L}}\p{{N}}/-]{{0,7}}\b"
    return c.rlike(prefixed) | c.rlike(ended)


def useful_place(c: Column) -> Column:
    """Whether a tidied name can be a locality: written as a name, short, and neither address, number, institution, province nor web page."""
    lower = c.rlike(r"^\p{Ll}") & ~c.rlike(r"\p{Lu}")
    vague = c.rlike(rf"{_I}\b(?:esta localidad|this locality|questa localit[aà])\b|^(?:district|distrito|bairro|barrio)\b")
    noisy = c.rlike(rf"{_I}\b(?:{WORD_NOISE})\b") | c.rlike(f"(?iu){URL_NOISE}") | c.rlike(rf"{_I}\b(?:{INSTITUTION_NOISE})\b") | c.rlike(rf"{_I}\b(?:{AUTHORITY_NOISE})\b")
    numbered = c.rlike(r"\b\d{2,}\b(?!\s*\))|\b[A-Z]{2,}\d+[A-Z0-9-]*\b") & ~c.rlike(r"\(\d{4,5}\)\s*$")
    return (c != "") & ~lower & ~vague & ~noisy & ~address_like(c) & ~numbered & ~c.rlike("(?:省|自治区|特别行政区)$") & (F.size(F.split(c, r"\s+")) <= 5)


def first_useful(candidates: list[Column]) -> Column:
    """The first candidate that is useful once tidied; later ones are not evaluated."""
    kept = lambda c: bind(tidy_place(c), lambda x: F.when(useful_place(x), x))
    return F.coalesce(*map(kept, candidates))


def explicit_city(title: Column, authority: Column) -> Column:
    """The place that a notice names: in Han script at the title's head, in the authority's name, then in the title."""
    title, authority = F.coalesce(title, F.lit("")), F.coalesce(authority, F.lit(""))
    han = bind(_group(title, HAN_LEAD), lambda h: F.when(h.rlike(HAN_UNITS) & ~h.rlike(f"(?:{HAN_SITES})$"), h))
    parts = F.filter(F.transform(F.split(title, r"\s*[–—-]\s*"), lambda s: F.regexp_replace(s, r"^[«»\"“”'\s]+|[«»\"“”'\s]+$", "")), lambda s: s != "")

    def dashed(p: Column) -> Column:
        """The first useful part that a street or a site follows."""
        pairs = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.when(b.rlike(rf"{_I}^(?:{AFTER_DASH})\b"), tidy_place(a)))
        return F.try_element_at(F.filter(pairs, lambda x: x.isNotNull() & useful_place(x)), F.lit(1))

    return first_useful([
        han,
        _group(authority, rf"{_I}\b(?:{BEFORE_PLACE})\s+(.+?){_END}"),
        _group(authority, rf"{_I}\b(?:{BEFORE_PROVINCE})\s+(.+?){_END}"),
        _group(authority, rf"{_I}^(?:{BEFORE_TOWN})\s+(.+?){_END}"),
        _group(authority, rf"{_I}^(.+?)\s+(?:{AFTER_PLACE}){_END}"),
        _group(authority, rf"{_I}^(.+?)\s+(?:{AFTER_TOWN}){_END}"),
        F.when(address_like(tidy_place(F.regexp_extract(title, BEFORE_ADDRESS, 2))), _group(title, BEFORE_ADDRESS)),
        _group(title, _I + BEFORE_TAIL),
        _group(title, AFTER_COMMA),
        bind(parts, lambda p: F.when(F.size(p) > 1, dashed(p))),
        _group(title, _I + AFTER_PREPOSITION),
        _group(title, _I + MUNICIPAL_TERM),
    ])


def place_label(c: Column) -> Column:
    """A label of a place, or null where it is noise."""
    return bind(tidy_place(c), lambda x: F.when(useful_place(x), x))


def shown_locality(title: Column, authority: Column, label: Column) -> Column:
    """The named place, or a label that says the same with more letters; the label where no place is named."""
    words = lambda c: F.filter(F.split(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")

    def chosen(p: Column) -> Column:
        a, b = words(p["city"]), words(p["label"])
        same = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
        return F.when(p["city"].isNull() | p["label"].isNull(), F.coalesce(p["city"], p["label"])).when(same & (F.length(p["label"]) >= F.length(p["city"])), p["label"]).otherwise(p["city"])

    return bind(F.struct(explicit_city(title, authority).alias("city"), place_label(label).alias("label")), chosen)


# --- address candidates --------------------------------------------------------------------------
# What sites and quarters begin with.
SITE_PREFIXES = r"campus|parque empresarial|parco|urbanizaci[oó]n|urbanizzazione|residenza|r[eé]sidence|groupe scolaire|coll[eè]ge|lyc[eé]e|gymnase|mus[eé]e"
QUARTER_PREFIXES = r"barrio|barriada|urbanizaci[oó]n|distrito|localit[aà]|frazione|quartiere|quartier|bairro"
# Words that no address holds, and what is only an abbreviation.
REFUSED_WORDS = r"cup|cig|codice|missione|lotto|pnrr|investimento|procedura|intervento|progetto|servizio|lavori|adeguamento|bando|pratica"
REFUSED_WHOLE = r"al|c\.?\s*\d+|art\.?\s*\d+|co\.?\s*\d+|comma\s+\d+|lett\.?\s*[a-z]|strasse\s+\d\S*|straße\s+\d\S*"

_START = r"(?:^|[^\p{L}\p{N}])"
_WORD = r"\p{Lu}[\p{L}\p{N}'’/-]*"
_LINK = r"(?:de la|de|del|della|dei|degli|des|du|la|le|las|los|das|dos|do|da|di|van|der|den|et|y|e)"
_NAME = rf"(?:{_LINK}\s+)?{_WORD}(?:\s+(?:{_LINK}\s+)?{_WORD}){{0,4}}"
_NUMBER = r"\d{1,4}[A-Za-z]?(?:\s*[-/]\s*\d{1,4}[A-Za-z]?)?"
_SIGN = r"(?:n[°ºo.]\.?\s*|nr\.?\s*|no\.?\s*)?"
_PREFIX = rf"(?i:c/|c\.|via|viale|piazza|piazzale|corso|largo|vicolo|lungomare|strada|boulevard|avenue|avenida|avda\.?|rue|route|calle|camino|carretera|plaza|paseo|ronda|rua|travessa|estrada|pra[çc]a|cal[çc]ada|rotunda|ul\.|ulica|aleja|bulevard|calea)"
#: The first letters of the prefixes of streets and of sites.
_PREFIX_STARTS = ["c/", "c.", "cor", "cal", "cam", "car", "via", "vic", "pia", "pla", "pas", "pra", "lar", "lun", "str", "bou", "bul", "ave", "avd", "rue", "rua", "rou", "ron", "rot", "tra", "est", "ul.", "uli", "ale"]
_SITE_STARTS = ["cam", "col", "par", "urb", "res", "rés", "gro", "lyc", "gym", "mus"]


def _ahead(starts: list[str]) -> str:
    """Look-ahead for one of some beginnings in any case, by their first letters."""
    either = lambda c: f"[{c}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c)
    after: dict[str, list[str]] = {}
    for x in starts:
        after.setdefault(x[0], []).append("".join(map(either, x[1:])))
    return f"(?=[{''.join(c + c.upper() for c in after)}])(?={'|'.join(either(c) + '(?:' + '|'.join(rest) + ')' for c, rest in after.items())})"


#: Look-ahead that changes no match but spares the engine most places: a run of letters before a number, first letters of prefixes.
_RUN_AHEAD, _STREET_AHEAD, _SITE_AHEAD = r"(?=[\p{L}'’/-]++\s+\d)", _ahead(_PREFIX_STARTS), _ahead(_SITE_STARTS)
#: Kinds in the order their candidates are listed, with patterns whose first group is the address.
ADDRESS_GROUPS = [
    ("street_address", rf"{_START}{_STREET_AHEAD}({_PREFIX}\s+{_NAME}(?:\s*,\s*|\s+){_SIGN}{_NUMBER})"),
    ("street_address", rf"{_START}((?:\p{{Lu}}[\p{{L}}'’/-]*\p{{Ll}}[\p{{L}}'’/-]*\s+)?{_RUN_AHEAD}[\p{{L}}'’/-]*(?:{STREET_ENDS})\s+{_NUMBER})"),
    ("street", rf"{_START}{_STREET_AHEAD}({_PREFIX}\s+{_NAME}(?:\s+{_NUMBER})?)"),
    ("locality", rf"{_START}((?i:localit[aà])\s+{_NAME})"),
    ("site", rf"{_START}{_SITE_AHEAD}((?i:{SITE_PREFIXES})\s+{_NAME})"),
]
#: What may follow an address, each with the locality as its first group.
ADDRESS_TAILS = [
    rf"^\s*[,;]\s*((?i:{QUARTER_PREFIXES})\s+{_NAME})",
    rf"^\s*[,;]\s*\d{{4,6}}\s+({_NAME})",
    rf"^\s*,?\s+(?:en|em|w|v|u)\s+({_NAME})",
    rf"^\s*,?\s+(?:à|au|aux|sur|sous)\s+({_NAME})",
    rf"^\s+(?:nel|in|a|na|no|te|i|im|am|bei|auf)\s+({_NAME})",
    rf"^\s*[-,]\s*({_NAME})\s*\((?:\d{{2,5}}|[A-Z]{{2}})\)",
]
TAIL = 120
_CANDIDATES = "array<struct<kind:string,address:string,hint:string>>"


def plain_pattern(pattern: str) -> str:
    """The pattern without its look-aheads, for engines that have none: it finds the same."""
    for ahead in (_RUN_AHEAD, _STREET_AHEAD, _SITE_AHEAD):
        pattern = pattern.replace(ahead, "")
    return pattern


def address_candidates(c: Column, noise: Callable[[Column, Column, Column], Column] | None = None, groups: list[tuple[str, str]] = ADDRESS_GROUPS) -> Column:
    """Array of (kind, address, hint) in the order of the groups, then of the text; candidates of different groups may overlap.

    Those with refused words go, and those that noise(address, before, after) calls noise in the 160
    characters before and 220 after. Candidates alike in kind and folded address are one, with the longest hint."""

    def of_group(t: Column, kind: str, pattern: str) -> Column:
        def candidate(m: Column) -> Column:
            address = F.regexp_replace(F.regexp_replace(m["value"], rf"{WS}+", " "), r"[\s,;:.]+$", "")
            tail = F.substring(t, m["end"] + 1, F.lit(TAIL))
            hint = bind(tail, lambda x: F.coalesce(*(or_null(F.regexp_extract(x, p, 1)) for p in ADDRESS_TAILS)))
            return F.struct(F.lit(kind).alias("kind"), address.alias("address"), hint.alias("hint"), m["start"].alias("start"), m["end"].alias("end"))

        def fit(x: Column) -> Column:
            a = x["address"]
            ok = ~a.rlike(rf"(?i)(?:^|\W)(?:{REFUSED_WORDS})(?:\W|$)") & ~a.rlike(rf"(?i)^(?:{REFUSED_WHOLE})$")
            if noise is not None:
                ok = ok & ~noise(a, window(t, x["start"], x["start"], 160, 0), F.substring(t, x["end"] + 1, F.lit(220)))
            return ok

        return F.filter(F.transform(located(t, pattern, 1), candidate), fit)

    def merged(all_: Column) -> Column:
        keyed = F.transform(all_, lambda x: F.struct(F.concat_ws("|", x["kind"], fold(x["address"])).alias("key"), x["kind"].alias("kind"), x["address"].alias("address"), x["hint"].alias("hint")))
        first = bind(F.transform(keyed, lambda x: x["key"]), lambda keys: F.filter(keyed, lambda x, i: F.array_position(keys, x["key"]) == i + 1))
        best = lambda key: F.aggregate(F.filter(keyed, lambda y: (y["key"] == key) & y["hint"].isNotNull()), F.lit(None).cast("string"), lambda s, y: F.when(s.isNull() | (F.length(y["hint"]) > F.length(s)), y["hint"]).otherwise(s))
        return F.transform(first, lambda x: F.struct(x["kind"].alias("kind"), x["address"].alias("address"), best(x["key"]).alias("hint")))

    def found(t: Column) -> Column:
        every = F.concat(*(of_group(t, kind, pattern) for kind, pattern in groups))
        return bind(every, lambda e: F.when(F.size(e) > 0, merged(e)).otherwise(F.array().cast(_CANDIDATES)))

    return bind(even(F.regexp_replace(F.coalesce(c, F.lit("")), "[–—]", "-")), found)


# --- noise on pages ------------------------------------------------------------------------------
# What stands beside the addresses of buyers, of plans, of a page's frame and of projects.
CONTACT = ["about the buyer", "auftraggeber", "bauherr", "architect", "architekt", "buyer", "contact", "contact name", "contracting authority", "telephone", "phone", "email", "website", "pec", "legalmail", "fax", "fon", "help", "serve aiuto"]
PLAN = ["lageplan", "maßstab", "plan-nr", "plan-id", "grundbuchbezirk", "gemarkung", "öffentlich bestellte", "vermessungsingenieure", "angefertigt nach amtlichen unterlagen", "urheberrechtlich geschützt"]
FRAME = ["footer", "privacy", "cookie", "copyright", "terms", "social", "share this notice", "watch this notice", "print this notice", "login", "accedi", "contenuti in evidenza", "notizie", "news"]
PROJECT = ["description", "descrizione", "planinhalt", "projekt", "subject of the contract", "oggetto", "project", "works", "lavori", "intervento", "obra", "rehabilit", "miglioramento", "realizzazione", "execution place", "place of performance", "emplazamiento", "sito en", "situado en", "ubicado en"]


def _spoken(markers: list[str]) -> list[str]:
    """Markers as the folded text spells them."""
    import unicodedata

    plain = lambda m: "".join(x for x in unicodedata.normalize("NFKD", m) if not unicodedata.combining(x)).lower()
    return list(dict.fromkeys(re.sub(r"[^\w]+", " ", plain(m)).strip() for m in markers))


_CONTACT, _PLAN, _FRAME, _PROJECT = map(_spoken, (CONTACT, PLAN, FRAME, PROJECT))
_BESIDE = rules.Markers(_CONTACT, _PLAN, _FRAME, _PROJECT)
_EMAIL, _PHONE = r"(?iuU)[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.[a-z]{2,}\b", r"\+?\d(?:[\d()./\-\s]{5,}\d)"


def page_noise(address: Column, before: Column, after: Column) -> Column:
    """Whether an address on a page is the buyer's, a plan's or the page frame's rather than the project's, by the
    words, addresses and numbers around it: in all of the window, and in its nearer 120 and 140 characters."""
    spoken = lambda c: F.trim(F.regexp_replace(match_text(c), r"[^\p{L}\p{N}]+", " "))
    count = lambda hits, words: F.size(F.array_intersect(hits, F.array(*map(F.lit, words))))

    def edge(text_: Column, words: list[str], last: bool) -> Column:
        """Place of the first or the last of some words, -1 for none."""
        hits = F.array_intersect(_BESIDE.hits(text_), F.array(*map(F.lit, words)))
        if last:
            return F.coalesce(F.array_max(F.transform(hits, lambda m: F.length(text_) - F.instr(F.reverse(text_), F.reverse(m)) + 1 - F.length(m))), F.lit(-1))
        return F.coalesce(F.array_min(F.transform(hits, lambda m: F.instr(text_, m) - 1)), F.lit(-1))

    def at(c: Column, pattern: str) -> Column:
        return F.when(c.rlike(pattern), F.length(F.regexp_extract(c, rf"(?s)^(.*?)(?:{pattern})", 1))).otherwise(-1)

    near_before, near_after = F.regexp_extract(before, r"(?s)(.{0,120})$", 1), F.substring(after, 1, 140)
    hits = F.struct(
        _BESIDE.hits(spoken(address)).alias("own"),
        _BESIDE.hits(spoken(F.concat_ws(" ", before, address, after))).alias("wide"),
        _BESIDE.hits(spoken(F.concat_ws(" ", near_before, address, near_after))).alias("near"),
        spoken(before).alias("b"),
        spoken(after).alias("a"),
    )

    def counted(h: Column) -> Column:
        signals = F.filter(F.array(edge(h["a"], _CONTACT, False), at(after, _EMAIL), at(after, _PHONE)), lambda x: x >= 0)
        return F.struct(
            (count(h["own"], _CONTACT) + count(h["own"], _FRAME)).alias("own"),
            *(count(h[w], words).alias(f"{w}_{n}") for w in ("wide", "near") for n, words in (("contact", _CONTACT), ("frame", _FRAME), ("project", _PROJECT), ("plan", _PLAN))),
            F.greatest(edge(h["b"], _CONTACT, True), edge(h["b"], _FRAME, True)).alias("lead_contact"),
            edge(h["b"], _PROJECT, True).alias("lead_project"),
            F.coalesce(F.array_min(signals), F.lit(-1)).alias("signal"),
            edge(h["a"], _PROJECT, False).alias("next_project"),
            F.concat_ws(" ", before, address, after).rlike(_EMAIL).alias("email"),
            after.rlike(_PHONE).alias("phone"),
            (near_before.rlike(_EMAIL) | near_after.rlike(_EMAIL)).alias("near_email"),
            near_after.rlike(_PHONE).alias("near_phone"),
        )

    def judged(n: Column) -> Column:
        by_contact = (n["lead_contact"] >= 0) & (n["lead_contact"] > n["lead_project"])
        by_project = (n["lead_project"] >= 0) & (n["lead_project"] > n["lead_contact"])
        followed = (n["signal"] >= 0) & ((n["next_project"] == -1) | (n["signal"] < n["next_project"]))
        framed = followed & ((n["near_contact"] >= 1) | (n["near_frame"] >= 1))
        none, near_none = n["wide_project"] == 0, n["near_project"] == 0
        return rules.decide(
            [
                (n["own"] > 0, True),
                (by_contact & (followed | n["near_email"] | n["near_phone"]), True),
                (framed & by_project & ~near_none, False),
                (framed & near_none, True),
                (n["near_email"] & (n["near_contact"] >= 2) & (n["near_project"] <= 2), True),
                (n["near_phone"] & (n["near_contact"] >= 2) & near_none, True),
                ((n["near_frame"] >= 1) & near_none, True),
                (n["email"] & (n["wide_contact"] >= 2) & (n["wide_project"] <= 1) & ~near_none, False),
                (n["email"] & (n["wide_contact"] >= 2) & (n["wide_project"] <= 1), True),
                (n["phone"] & (n["wide_contact"] >= 2) & none, True),
                ((n["wide_contact"] >= 3) & none, True),
                ((n["wide_frame"] >= 1) & none, True),
                ((n["wide_plan"] >= 2) & (n["wide_contact"] >= 1) & none, True),
                ((n["near_plan"] >= 2) & (n["near_contact"] >= 1) & near_none, True),
            ],
            False,
        )

    return bind(hits, lambda h: bind(counted(h), judged))
