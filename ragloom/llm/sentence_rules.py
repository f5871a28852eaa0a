"""Segmentation rule tables: ordered pairs of a pattern before and a pattern after a position.

The first rule of a language's cascade that matches at a position decides it. A rule with `span` set protects every
position between the two patterns instead of one position.
"""

from __future__ import annotations

from dataclasses import dataclass

_CLOSE = r"[\"'”’»›“‘)\]}」』）】》〉＂＇]"
_STOP = r"[.!?…‼⁇⁈⁉]"
_WIDE_STOP = r"[。！？．｡]"
# A run of stops with its closing marks. It is entered at its start only and never re-read, so long runs stay linear.
_STOPS = r"(?<!" + _STOP + ")" + _STOP + "++" + _CLOSE + "*+"


@dataclass(frozen=True)
class Rule:
    breaks: bool
    before: str
    after: str
    span: bool = False


def no(before: str, after: str) -> Rule:
    return Rule(False, before, after)


def yes(before: str, after: str) -> Rule:
    return Rule(True, before, after)


def span(opening: str, closing: str) -> Rule:
    return Rule(False, opening, closing, span=True)


def words(text: str) -> str:
    return "|".join(sorted((w.replace(".", r"\.").replace(" ", r"\s+") for w in text.split("|")), key=len, reverse=True))


_BREAK = r"[^\S\n]*\r?\n"
_MARKER = r"(?:[-*•‣◦·–—]|\(?\d{1,3}[.)])[^\S\n]+\S"

# Abbreviations after which a sentence goes on.
EN_TITLES = words("Dr|Mr|Mrs|Ms|Prof|Capt|Gen|Col|Lt|Sgt|Maj|St|Rev|Hon|Sen|Rep|Gov|Pres|Messrs|Mt|Ft")
EN_MIDDLE = words("vs|approx|i.e|e.g|cf|viz|al|ca|resp|incl|excl|est|esp|Ph.D|M.D|B.A|M.A|D.C|U.S|U.N|U.K|E.U|Co|Corp|Bros|dept|Dept|univ|Univ")
EN_NUMBERED = words("no|No|nos|Nos|Nr|nr|fig|Fig|figs|Figs|sec|Sec|secs|Secs|eq|Eq|vol|Vol|ch|Ch|art|Art|p|pp|Tab|tab|App|app|par|ver|v|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec")
EN_DAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|May|June|July|August|September|October|November|December|EST|GMT|UTC|Mon|Tue|Wed|Thu|Fri|Sat|Sun"
EN_SAYING = "said|says|asked|asks|shouted|replied|added|wrote|cried|called|answered|whispered|noted|explained"
EN_STARTS = "The|A|An|It|This|That|These|Those|In|On|At|No|They|He|She|We|If|When|There"
DE_MIDDLE = words("Dr|Prof|Hr|Fr|Nr|ca|d.\\s*h|z.\\s*B|u.\\s*a|bzw|vgl|evtl|ggf|inkl|exkl|Abb|Tab|Kap|Bd|S|Str|St|Tel|Art|Abs|Mio|Mrd|bspw|sog|Dipl|Ing|jun|sen|geb|gest|max|min|zzgl|i.\\s*d.\\s*R|o.\\s*ä|u.\\s*U")
DE_MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Quartal|Klasse|Etage|Stock|Kapitel"
FR_MIDDLE = words("M|MM|Mme|Mlle|Dr|Pr|Me|St|Ste|p|pp|fig|Fig|chap|art|vol|n°|no|cf|env|ex|av|apr|éd|tél|réf|etc.\\s*,")
HI_MIDDLE = "डॉ|श्री|श्रीमती|प्रो|पं|सं|कु|क्र|रु"
KO_NUMBERED = words("No|no|Nr|Fig|fig|Vol|vol|pp|p|Dr|Mr|Mrs|Ms|Prof|St|vs|approx|e.g|i.e|Ph.D|Co|Ltd|Inc")


def _syllables(*finals: int) -> str:
    """Hangul syllables with the given final consonants, by their numbers in the syllable block."""
    return "".join(chr(0xAC00 + 28 * i + f) for i in range(399) for f in finals)


#: Declarative endings close a sentence even without a stop: past or present stem (finals n, ss, bs), copula, formal.
KO_PLAIN = r"(?:[" + _syllables(4, 18, 20) + r"이니]다)"
# Polite endings.
KO_POLITE = r"(?:어요|아요|여요|에요|예요|세요|네요|군요|나요|가요|까요|지요|해요|죠)"

LAYOUT = (
    # A list item on a line of its own, marker included; an ordinal or date that was wrapped is no marker.
    no(r"\b(?:[Aa]m|[Dd]en|[Vv]om|[Zz]um|[Dd]er|[Bb]is|[Nn]o\.|[Nn]r\.|[Nn]os\.|[Ff]ig\.|[Ss]ec\.|und|and|\d,)" + _BREAK, r"[^\S\n]*\d+[.)]"),
    no(r"\d{4}\.(?:\s+\d{1,2}\.)?" + _BREAK, r"[^\S\n]*\d{1,2}\."),
    yes(r"\n", r"[^\S\n]*" + _MARKER),
    # A paragraph ends at a blank line.
    yes(r"\n", r"[^\S\n]*\r?\n"),
    yes(r"\n[^\S\n]*\r?\n", r""),
    # Nothing breaks right after a marker at the start of a line.
    no(r"(?:^|\n)[^\S\n]*\(?\d{1,3}[.)]", r"\s"),
)

#: Quotations and brackets are kept whole where they close in the same paragraph.
def _spans(*pairs: str) -> tuple[Rule, ...]:
    return tuple(span(a, b) for a, b in (p.split(" ") for p in pairs))


LATIN_QUOTES = _spans("“ ”", '" "', "« »", "( )", "[ ]")
EAST_QUOTES = _spans("“ ”", "「 」", "『 』", "（ ）", "《 》", '" "', "( )")

# A sentence that follows without a blank.
GLUED = (
    yes(r"(?<=\p{Ll}{2}|[\d%])" + _STOPS, r"[\"“‘«(]?(?:\p{Lu}\p{Ll}|\p{Lu}\.?\s)"),
    yes(r"(?<=[가-힣])" + _STOPS, r"[\"“‘(]?[가-힣\p{Lu}\d]"),
)

ENGLISH = LAYOUT + LATIN_QUOTES + (
    # A quotation goes on with its reporting clause; a decimal point or an ellipsis goes on in lower case.
    no(_STOP + _CLOSE + "*", r"\s+[\"'“‘(]?\p{Ll}"),
    no(_STOP + "[\"”’]", r"\s+(?:\p{Lu}[\w.]*\s+){1,3}(?:" + EN_SAYING + r")[.!?]"),
    no(r"\b(?:" + EN_TITLES + r")\.", r"\s"),
    yes(r"\p{Ll}\s+[A-Z]\.", r"\s+(?:" + EN_STARTS + r")\s"),
    no(r"(?:^|[\s(\"“‘'.!?])(?:[A-Z]\.[^\S\n]*)*[A-Z]\.", r"\s+(?:[A-Z]\.|[A-Z][a-z])"),
    no(r"\b(?:" + EN_MIDDLE + r")\.", r"\s"),
    no(r"\b(?:" + EN_NUMBERED + r")\.", r"\s+[\d(#]"),
    no(r"\b[ap]\.m\.", r"\s+(?:" + EN_DAYS + r")\b"),
    no(r"\b(?:etc|Inc|Ltd|Jr|Sr)\.", r"\s+[a-z\d(&]"),
    yes(_STOPS, r"\s"),
        yes(_WIDE_STOP + _CLOSE + "*+", r"[^。！？．｡”’」』）\"')]"),
) + GLUED

GERMAN = LAYOUT + _spans("„ “", "» «", "« »", "‚ ‘", '" "', "( )") + (
    no(_STOP + _CLOSE + "*", r"\s+[\"„‚(]?[a-zäöüß]"),
    no(r"\b(?:" + DE_MIDDLE + r")\.", r"\s"),
    no(r"\b\d{1,2}\.", r"\s+(?:" + DE_MONTHS + r"|\d)"),
    no(r"\b(?:am|den|vom|zum|der|dem|im|Am|Den|Vom|Zum|Der|Dem|Im)\s+\d{1,3}\.", r"\s"),
    no(r"(?:^|[\s(])[A-ZÄÖÜ]\.", r"\s+[A-ZÄÖÜ]"),
    yes(_STOPS, r"\s"),
    yes(_WIDE_STOP + _CLOSE + "*+", r"[^。！？．｡”’」』）\"')]"),
) + GLUED

FRENCH = LAYOUT + _spans("« »", "“ ”", '" "', "( )") + (
    no(_STOP + r"+[^\S\n]*" + _CLOSE + "*", r"\s+[\"«“(]?\s*[a-zàâäçéèêëîïôöùûüœ]"),
    no(_STOP, r"[^\S\n]+[!?»]"),
    no(r"\b(?:" + FR_MIDDLE + r")\.", r"\s"),
    no(r"(?:^|[\s(])[A-ZÀÂÇÉÈÊËÎÏÔÙÛ]\.", r"\s+[A-Z]"),
    yes(r"(?<![!?.…])[!?.…]++[^\S\n]?»", r"\s"),
    yes(_STOPS, r"\s"),
    yes(_WIDE_STOP + _CLOSE + "*+", r"[^。！？．｡”’」』）\"')]"),
) + GLUED

KOREAN = LAYOUT + _spans("“ ”", "‘ ’", '" "', "( )", "（ ）", "「 」", "『 』") + (
    # A quotation or bracket goes on with its particle.
    no(_STOP + _CLOSE + "+", r"\s*(?:라고|이라고|라는|이라는|라며|라면서|고|하고|며|이라며|라|이란|란|는)(?=\s|$)"),
    no(r"\d\.", r"\s"),
    no(r"\b(?:" + KO_NUMBERED + r")\.", r"\s"),
    # An ellipsis ends a sentence only after a closing ending.
    yes(r"[다요까죠네라자오음함됨임](?:…+|\.{2,})" + _CLOSE + "*", r"\s"),
    no(r"(?:…|\.{2,})", r"\s"),
    yes(_STOPS, r"\s"),
    yes(_WIDE_STOP + _CLOSE + "*+", r"[^。！？．｡”’」』）\"')]"),
    # Endings without a stop.
    yes(r"(?:" + KO_PLAIN + "|" + KO_POLITE + ")", r"\s+\S"),
) + GLUED

JAPANESE = LAYOUT + EAST_QUOTES + (
    no(_WIDE_STOP + r"+[」』”）]+", r"(?:と|って|という|との|とか|など|は|が|を|に|の|も|で|へ|、|，|。)"),
    no(r"\d．", r"\d"),
    yes(r"(?<![。！？．｡!?])[。！？．｡!?]++[」』”）)]*+", r"[^。！？．｡!?」』”）)、，]"),
    yes(r"\.[」』”）)]*", r"\s+[぀-ヿ一-鿿]"),
    yes(r"…", r"\s*\n"),
)

CHINESE = LAYOUT + EAST_QUOTES + (
    # A quotation that isn't introduced by a colon is a part of the clause around it.
    no(r"(?<![：:][^\S\n]{0,2})(?:“[^“”\n]*”|「[^「」\n]*」)(?<=[。！？…][”」])", r"[^\s“「（。！？]"),
    no(r"\d．", r"\d"),
    yes(r"(?<![。！？．｡!?])[。！？．｡!?]++[」』”’）)]*+", r"[^。！？．｡!?」』”’）)，、]"),
    yes(r"\.[”）)]*", r"\s+[一-鿿]"),
)

HINDI = LAYOUT + _spans("“ ”", '" "', "‘ ’", "( )") + (
    no(r"(?:" + HI_MIDDLE + r")\.", r"\s"),
    no(r"[।॥!?]" + _CLOSE + "+", r"\s*(?:कहा|बोले|बोला|बोली|पूछा|ऐसा|यह\s+कहकर)"),
    yes(r"(?<![।॥!?…])[।॥!?…]++" + _CLOSE + "*+", r"\s"),
    yes(r"[।॥]" + _CLOSE + "*", r"[^\s।॥”’\")]"),
    yes(r"[ऀ-ॿ]\." + _CLOSE + "*", r"\s"),
)

THAI = LAYOUT + _spans("“ ”", '" "', "( )") + (
    # Blanks part sentences, but not around numbers, signs and the repetition mark.
    yes(r"[!?]" + _CLOSE + "*", r"\s"),
    no(r"[^฀-๿”\")]", r"\s"),
    no(r"", r"\s+(?:[^\s฀-๿“\"(]|ๆ|ฯ)"),
    yes(r"[฀-๿”\")]", r"\s+[฀-๿“\"(]"),
)

TABLES = {
    "en": ENGLISH, "de": GERMAN, "fr": FRENCH, "kr": KOREAN, "ko": KOREAN, "ja": JAPANESE, "zh": CHINESE, "hi": HINDI, "th": THAI,
}
