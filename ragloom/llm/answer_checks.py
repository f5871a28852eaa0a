"""Checks of one answer: structure, copying, script and refusal. Plain functions over one text."""

from __future__ import annotations

import re

# Answers that stand for no answer.
PLACEHOLDERS = frozenset("""n/a|na|none|null|nil|nan|undefined|empty|blank|unknown|tbd|todo|no answer|no response|not available|
not applicable|없음|해당 없음|해당없음|답변 없음|답 없음|무응답|비어 있음|미정|내용 없음""".replace("\n", "").split("|"))

_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_TAG = re.compile(r"</?[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>")
# Labels in front of an answer.
_LABEL = re.compile(
    r"^\s*(?:(?:answer|response|a|final answer|답변|답|대답)\s*[:：]|based on (?:the )?(?:passage|context|document|text)s?(?: \d+)?\s*[:,]"
    r"|according to (?:the )?(?:context|passage|document|text)s?(?: \d+)?\s*[:,]?|문맥에 따르면|문서에 따르면|지문에 따르면"
    r"|\[(?:참조|ref(?:erence)?)\s*\d+\]|thank you for asking about [^.?!]*[.?!]|thanks for (?:your|the) question[.!]?"
    r"|[^.?!\n]{1,60}에 관한 질문 감사합니다\.?|질문 감사합니다\.?)\s*", re.I)
# Labels in front of a repeated question.
_ASKED = re.compile(r"^\s*(?:>+\s*)?(?:q(?:uestion)?\s*[.:：]|you asked\s*[:：]|the question (?:was|is)\s*[:：]?|질문\s*[:：]|물으신 내용\s*[:：]|문의\s*[:：])\s*", re.I)


def bare(answer: str) -> str:
    """The answer without invisible characters, markup tags and labels in front."""
    return unlabelled(_TAG.sub(" ", answer))


def unlabelled(answer: str) -> str:
    """The answer without invisible characters and labels in front."""
    text = _INVISIBLE.sub("", answer).strip()
    while True:
        rest = _LABEL.sub("", text, count=1)
        if rest == text:
            return text.strip()
        text = rest


def is_empty(answer: str | None) -> bool:
    """No letters or digits besides markup and labels, or a placeholder."""
    if answer is None:
        return True
    text = bare(answer)
    if not any(ch.isalnum() for ch in text):
        return True
    return re.sub(r"^[\s\W_]+|[\s\W_]+$", "", text).casefold() in PLACEHOLDERS


WORD, DIGITS = re.compile(r"\w+"), re.compile(r"\d+")


def _words(text: str) -> list[str]:
    return WORD.findall(text.casefold())


def tiles(a: list[str], b: list[str], least: int = 3) -> int:
    """Greedy string tiling: words of `a` covered by the longest common runs with `b`, each word used once.

    The longest run is marked first, again and again, until no unmarked run of `least` words is left.
    """
    marked_a, marked_b = [False] * len(a), [False] * len(b)
    where: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    covered = 0
    while True:
        best, runs = least - 1, []
        for i, w in enumerate(a):
            if marked_a[i]:
                continue
            for j in where.get(w, ()):
                if marked_b[j]:
                    continue
                n = 0
                while (i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]
                       and not marked_a[i + n] and not marked_b[j + n]):
                    n += 1
                if n > best:
                    best, runs = n, [(i, j)]
                elif n == best and n >= least:
                    runs.append((i, j))
        if best < least:
            return covered
        for i, j in runs:
            if not any(marked_a[i:i + best]) and not any(marked_b[j:j + best]):
                marked_a[i:i + best] = [True] * best
                marked_b[j:j + best] = [True] * best
                covered += best


def is_copied(question: str | None, answer: str) -> bool:
    """Nothing but the question, once or repeated: its tiles cover the whole answer and nearly the whole question."""
    if not question:
        return False
    a, q = _words(_ASKED.sub("", bare(answer))), _words(question)
    known = set(q)
    if not a or not q or len(a) < 0.8 * len(q) or sum(w in known for w in a) < len(a) - len(a) // 10:
        return False
    covered = sum(tiles(a[i:i + len(q)], q, min(3, len(q))) for i in range(0, len(a), len(q)))
    return covered >= len(a) - len(a) // 10 and covered >= 0.8 * len(q)


# Forms in which an answer is declined. They speak of the answering, not of the matter.
_REFUSALS = re.compile("|".join((
    r"^(?:i['’]?m |i am )?(?:very |so )?sorry\b.{0,40}\b(?:can(?:no|['’])t|cannot|unable|not able|no answer|not possible|won['’]t)",
    r"^(?:unfortunately|regrettably|apologies|sorry)\b[^.]{0,60}\b(?:i|we|me)\b[^.]{0,40}\b(?:can(?:no|['’])t|cannot|unable|not able|can talk|not allowed|won['’]t)",
    r"^(?:sorry|apologies),? no answer\b", r"\boutside (?:of )?what i (?:can|may|am able)", r"\bbeyond (?:my|the) (?:scope|knowledge|abilit)",
    r"^i (?:really |simply |honestly )?(?:do not|don['’]t|did not|didn['’]t) (?:know|have (?:enough|any|the|access))\b",
    r"^i (?:can(?:no|['’])t|cannot|can not|could not|couldn['’]t|will not|won['’]t|am unable|am not able|am not allowed|['’]m unable|['’]m not able)\b",
    r"\bi (?:must|have to|would like to|will|shall) (?:respectfully |politely )?(?:decline|refuse|abstain)", r"\bi would (?:rather|prefer) not (?:to )?\w+",
    r"\b(?:it would be|it is|that is) (?:inappropriate|not appropriate|improper) (?:for me )?to (?:respond|answer|comment|discuss|say)",
    r"\bas an? (?:ai|assistant|language model|ai assistant|ai language model)\b[^.]{0,40}\b(?:not|cannot|can['’]t|unable)",
    r"\bmy (?:instructions|guidelines|rules|policies|policy) (?:do|does) not (?:let|allow|permit)", r"\bno comment (?:can|will|may)\b", r"^no comment\b",
    r"\b(?:context|passages?|text|documents?|information|source)s? (?:provided |given )?(?:says?|said|mentions?|gives?|contains?|has|have) (?:nothing|no information|no mention)\b",
    r"\b(?:context|passages?|text|documents?|information)s? (?:do(?:es)? not|doesn['’]t|don['’]t) (?:mention|say|contain|include|provide|cover|state|answer)\b",
    r"\b(?:there is |there['’]s )?(?:not enough|insufficient|no) information\b[^.]{0,40}\b(?:answer|context|text|passage|given|provided)",
    r"^(?:it is |it['’]s )?(?:unable|impossible|not possible) to (?:determine|answer|say|tell|know)\b", r"\b(?:this|that|it|the (?:answer|question)|which)\s+cannot be (?:determined|answered) from\b", r"^cannot be (?:determined|answered)\b", r"\bcannot be (?:determined|answered) from (?:the |this |these |given )*(?:context|passage|text|document|information|source)", r"\bi will not guess\b",
    r"(?:모르겠|알지 못|알 수 없)(?:습니다|어요|네요|다)", r"(?:답변|대답|답|말씀|안내|조언|도움)(?:을|를|은|는|도|이|가)? ?(?:드릴|할|해 드릴|드리거나|줄) ?(?:수|권한)(?:가|는|도|이)? ?없",
    r"(?:답변|대답|말씀)(?:을|를|은|는)? ?(?:드리|하|제공하)(?:지|기)(?:는|가)? ?(?:못|않겠|어렵|곤란)", r"답변(?:을|은)? ?제공하지 않", r"대답하기 (?:어렵|곤란)", r"말씀드리지 못",
    r"(?:안내|답변|말)(?:을|를)? ?할 권한(?:이|은)? ?없", r"(?:다룰|답할|말할|도울) 수 있는 범위(?:를|가|에서)? ?(?:벗어|아닙)", r"(?:문맥|문서|지문|본문|자료)에(?:는|서는)? ?(?:[가-힣]+ ){0,2}(?:정보|내용|언급)(?:가|이|은|는)? ?없",
    r"(?:정보|내용)(?:가|이)? ?(?:부족|충분하지)", r"(?:답변|응답)(?:을|를)? ?(?:거부|거절|사양)", r"조언(?:은|을)? 드릴 수 없",
)), re.I)


def _rule(*parts: str) -> str:
    """A sentence form: its parts in order, with blanks or nothing between them."""
    return r"\s*".join(parts)


def _any(text: str) -> str:
    return "(?:" + "|".join(w.replace(" ", r"\s+").replace("'", "['’]") for w in text.split("|")) + ")"


# The grammar of refusals. Its word classes. A refusal is (lead) speaker x lacking ability x act of answering,
# (lead) speaker x lacking knowledge, or source x lacking x answer; the object stays open.
_EN = {
    "lead": r"^(?:(?:(?:i['’]m|i am|we['’]re|we are)\s+)?(?:(?:very|so|really|truly)\s+)?(?:afraid|sorry|unfortunately|regrettably|sadly|apologies|alas|no)\b[,.:]?\s*(?:but\s+|that\s+)?)?",
    "speaker": _any("i|we|this assistant|the assistant"),
    "unable": _any("cannot|can't|can not|could not|couldn't|won't|will not|would not|am unable to|are unable to|'m unable to|'re unable to|am not able to|are not able to|'m not able to|'re not able to|"
                   "am not allowed to|are not allowed to|am not in a position to|don't feel able to|must decline to|have to decline to|refuse to|decline to"),
    "act": _any("answer|respond|reply|help|assist|say|tell|comment|provide|give|share|disclose|discuss|offer|advise|determine|confirm|find|speculate|guess"),
    "unknowing": _any("have no idea|have no clue|have no answer|have no information|have no knowledge|do not know|don't know|am not sure what|wouldn't know|would not know|could not say|couldn't say"),
    "source": r"(?:the|this|that|your|my|our|these|those)?\s*(?:given\s+|provided\s+)?(?:context|passage|text|document|source|information|material|excerpt|article|note)s?",
    "lacking": _any("gives no|give no|has no|have no|contains no|contain no|holds no|hold no|offers no|offer no|provides no|provide no|lacks an|lack an|lacks the|does not give an|does not hold an|doesn't give an|doesn't hold an"),
}
_GRAMMAR = re.compile("|".join((
    _rule(_EN["lead"], _EN["speaker"], _EN["unable"], _EN["act"]) + r"\b",
    _rule(_EN["lead"], _EN["speaker"], r"(?:really\s+|honestly\s+)?", _EN["unknowing"]) + r"\b",
    _rule(_EN["lead"], _EN["source"], _EN["lacking"], "(?:answer|information|details?|mention)") + r"\b",
    r"^(?:that|this|it)(?:['’]s|\s+is)\s+(?:not\s+(?:something|a\s+(?:question|topic|matter))|nothing)\s+(?:that\s+)?(?:i|we)\s+(?:can|could|am able to|are able to)\s+" + _EN["act"] + r"\b",
    r"^no\s+(?:clue|idea)\s*(?:[,.!]|$|about\b|sorry\b)", r"^(?:i|we)\s+wish\s+(?:i|we)\s+could\s+" + _EN["act"] + r"\b.{0,40}\bbut\b",
    # German, French, Japanese, Chinese: the same three forms.
    r"^(?:(?:leider|entschuldigung|es tut mir leid|tut mir leid|verzeihung)[,.]?\s*(?:aber\s+)?)?(?:das\s+)?(?:kann|können|darf|dürfen)\s+(?:ich|wir)\b[^.]{0,60}\b(?:nicht|keine?)\b[^.]{0,30}\b(?:beantworten|antworten|helfen|sagen|geben|mitteilen)",
    r"^(?:(?:leider|entschuldigung|es tut mir leid|tut mir leid)[,.]?\s*(?:aber\s+)?)?(?:ich|wir)\s+(?:kann|können|darf|dürfen)\b[^.]{0,60}\b(?:nicht|keine?)\b[^.]{0,30}\b(?:beantworten|antworten|helfen|sagen|geben|mitteilen)",
    r"^(?:leider\s+)?(?:das\s+)?weiß\s+ich\s+(?:leider\s+)?nicht\b", r"^ich\s+weiß\s+(?:es|das)?\s*(?:leider\s+)?nicht\b",
    r"^(?:désolée?|malheureusement|je regrette|navrée?)?[,.]?\s*(?:mais\s+)?(?:je|nous)\s+ne\s+(?:peux|pouvons|puis|suis|sommes)\s+(?:malheureusement\s+)?pas\b[^.]{0,40}\b(?:répondre|aider|dire|donner|fournir)",
    r"^(?:désolée?[,.]?\s*)?je\s+ne\s+sais\s+pas\b",
    r"(?:お答え|回答|お伝え|お手伝い|お話し|ご案内)(?:することは|することが|は|を|が)?(?:でき(?:ません|ない|かねます)|いたしかねます|しかねます)", r"^(?:申し訳(?:ありません|ございません)が?[、。]?)?(?:わかりません|分かりません|存じません|知りません)",
    r"(?:无法|不能|不便|难以)(?:为您|为你|对此|就此)?(?:回答|答复|提供|告知|作答|帮助)", r"^(?:抱歉|对不起|很遗憾)?[，,。]?\s*我(?:也)?不(?:知道|清楚|了解)",
)), re.I)


def is_refusal(question: str | None, answer: str) -> bool:
    """Declines, or claims not to know. Only the first sentences count, behind labels and a repeated question."""
    text = bare(answer)
    if question and text.startswith(question):
        text = bare(text[len(question):])
    for _ in range(2):
        if _REFUSALS.search(text) or _GRAMMAR.search(text):
            return True
        text = bare(text)
    return False


# Frequent short words of languages in Latin script.
_COMMON = {
    "en": frozenset("the of and to in is was were that it for on with as are be this by at from have had not they which or an but after before because no cannot must".split()),
    "de": frozenset("der die das und ist nicht ein eine einen den dem des mit von zu auf für im wird wurde wurden nach danach bei aus sind war auch sich als".split()),
    "fr": frozenset("le la les des est et un une dans pour que qui sur avec pas par du au aux ne sont été plus cette ce il elle nous vous".split()),
    "es": frozenset("el la los las de del y en un una por con para que se no es fue son está falta como más su al sin".split()),
    "it": frozenset("il lo gli le di del della e un una per con che non è sono nel alla da si".split()),
    "nl": frozenset("de het een en van is niet dat die op te zijn met voor aan er ook als bij maar om uit door over nog naar wordt werd heeft deze dit hij zij wij".split()),
    "sv": frozenset("och att det som en ett är på av för med inte den till om har de var jag men eller vid från kan efter".split()),
    "pl": frozenset("i w na nie się jest z do to że o jak po od za przez dla był była są oraz ale".split()),
    "pt": frozenset("o a os as de do da e um uma por com para que se não é foi são no na".split()),
}
# Ways in which a question asks for a word of another language.
_ASKS_WORD = re.compile(
    r"\b(korean|english|japanese|chinese|german|french)\b[^.?]{0,30}\b(?:name|word|term|translation|spelling)|\b(?:name|word|term|called|say)\b[^.?]{0,40}\bin (korean|english|japanese|chinese|german|french)\b"
    r"|(영어|한국어|일본어|중국어|독일어|프랑스어|영문|국문)(?:로|식)?[^.?]{0,12}(?:이름|명칭|단어|말|용어|표기|뭐라고|무엇)", re.I)
_NAMED = {"korean": "kr", "english": "en", "japanese": "ja", "chinese": "zh", "german": "de", "french": "fr",
          "영어": "en", "영문": "en", "한국어": "kr", "국문": "kr", "일본어": "ja", "중국어": "zh", "독일어": "de", "프랑스어": "fr"}


def scripts(text: str) -> dict[str, int]:
    out = {"latin": 0, "hangul": 0, "kana": 0, "han": 0, "other": 0}
    for ch in text:
        if not ch.isalpha():
            continue
        code = ord(ch)
        if code < 0x250 or 0x1E00 <= code < 0x1F00:
            out["latin"] += 1
        elif 0xAC00 <= code <= 0xD7A3 or 0x1100 <= code < 0x1200 or 0x3130 <= code < 0x3190:
            out["hangul"] += 1
        elif 0x3040 <= code < 0x3100:
            out["kana"] += 1
        elif 0x4E00 <= code < 0xA000:
            out["han"] += 1
        else:
            out["other"] += 1
    return out


def latin_language(text: str) -> str | None:
    """The language in Latin script whose frequent words stand out, else null."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    hits = {k: sum(w in v for w in words) for k, v in _COMMON.items()}
    marks = {"de": len(re.findall("[äöüß]", text.lower())), "fr": len(re.findall("[àâçèêëîïôùûœ]|[ld]’|n’", text.lower())), "es": len(re.findall("[ñí¿¡óáú]", text.lower()))}
    score = {k: 2 * n + marks.get(k, 0) for k, n in hits.items()}
    best = max(score, key=lambda k: (score[k], k == "en"))
    return best if score[best] >= 3 and score[best] > score["en"] or best == "en" and score["en"] > 0 else None


def text_language(text: str) -> str | None:
    """Language by script, for Latin script by frequent words; null where nothing can be said."""
    n = scripts(text)
    total = sum(n.values())
    if total < 3:
        return None
    if n["kana"] >= 0.15 * total:
        return "ja"
    if n["hangul"] >= 0.3 * total:
        return "kr"
    if n["han"] >= 0.5 * total:
        return "zh"
    if n["other"] >= 0.5 * total:
        return "other"
    return latin_language(text) or "latin"


def is_wrong_language(question: str | None, language: str | None, answer: str) -> bool:
    """Not in the question's language, unless the question asks for a word of the language it is in."""
    text = bare(answer)
    if question and text.startswith(question):
        text = text[len(question):]
    got = text_language(text)
    want = language or (text_language(question) if question else None)
    if got is None or want is None:
        return False
    want = "kr" if want == "ko" else want
    if got == want or got == "latin" and want in _COMMON:
        return False
    asked = _ASKS_WORD.search(question or "")
    if asked:
        named = _NAMED.get(next(g for g in asked.groups() if g).lower())
        if named == got or got == "latin" and named in _COMMON:
            return False
    if want in _COMMON and got in _COMMON:
        # Names can look like another language; a sentence of another language has several of its words.
        return latin_language(text) not in (want, None) and len(text.split()) >= 4
    return True


_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "“": "”", "«": "»", "【": "】", "《": "》"}
_CLOSERS = frozenset(_OPEN.values())
_VOID = frozenset("br hr img input meta link wbr".split())
_LIST_ITEM = re.compile(r"^\s*(?:[-*•]|\(?\d{1,3}[.)]|[a-z][.)])\s*(.*)$")
_WHOLE_TAG = re.compile(r"<(/?)([A-Za-z][\w:-]*)(?:\s[^<>]*)?(/?)>")
_CUT_TAG = re.compile(r"</?[A-Za-z][\w:-]*(?:\s[^<>]*)?$")
_INTRODUCES = re.compile(r"[:：]\s*$")


def structure_fault(text: str) -> str | None:
    """What a pushdown parser finds open at the end: fence, code, bracket, quotation, tag or list item."""
    stack: list[str] = []
    fence = None
    for line in text.split("\n"):
        mark = re.match(r"\s*(```+|~~~+)", line)
        if mark:
            if fence is None:
                fence = mark.group(1)[:3]
                if line.count(fence) > 1 and line.strip() != fence:
                    fence = None
                continue
            if mark.group(1).startswith(fence):
                fence = None
            continue
        if fence:
            continue
        if line.count("`") % 2:
            stack.append("`")
        body = _LIST_ITEM.match(line)
        start = len(line) - len(body.group(1)) if body else 0
        i = start
        while i < len(line):
            ch = line[i]
            if ch == "<":
                tag = _WHOLE_TAG.match(line, i)
                if tag:
                    name = tag.group(2).lower()
                    if tag.group(1):
                        if f"<{name}>" in stack:
                            while stack.pop() != f"<{name}>":
                                pass
                    elif not tag.group(3) and name not in _VOID:
                        stack.append(f"<{name}>")
                    i = tag.end()
                    continue
                if _CUT_TAG.match(line, i):
                    return "tag"
            elif ch == '"' and not (i and line[i - 1].isdigit()):
                if '"' in stack:
                    while stack.pop() != '"':
                        pass
                else:
                    stack.append('"')
            elif ch in _OPEN:
                stack.append(_OPEN[ch])
            elif ch in _CLOSERS and ch in stack:
                while stack.pop() != ch:
                    pass
            i += 1
    if fence:
        return "fence"
    if stack:
        return {"`": "code", '"': "quotation", "”": "quotation", "»": "quotation", "」": "quotation", "』": "quotation"}.get(
            stack[-1], "tag" if stack[-1][0] == "<" else "bracket")
    lines = [x for x in text.split("\n") if x.strip()]
    if lines:
        last = _LIST_ITEM.match(lines[-1])
        if last and not last.group(1).strip() and len(lines) > 1:
            return "list"
        if _INTRODUCES.search(lines[-1]):
            return "list"
        inline = re.search(r"(?:^|\s)(\d{1,2})[.)]\s*$", lines[-1])
        if inline and int(inline.group(1)) > 1 and re.search(rf"(?:^|[:：\n]\s*|\s){int(inline.group(1)) - 1}[.)]\s+\w", text) and re.search(r"(?:^|[:：\n]\s*)1[.)]\s", text):
            return "list"
    return None


#: Marks after which a text can't end.
OPEN_END = re.compile(r"[,，、;；:：–—\-(（\[{“「«‘&/+=]\s*$")
STOP_END = re.compile(r"[.!?。！？．।…][\"'”’»)）\]」』*_`]*\s*$")


def open_end(text: str) -> bool:
    return bool(OPEN_END.search(text)) or structure_fault(text) is not None


def closed_end(text: str) -> bool:
    return bool(STOP_END.search(text))


def last_words(text: str) -> tuple[str, str]:
    """The last two words in lower case, digits as 0; empty where there are fewer."""
    words = ["0" if w.isdigit() else DIGITS.sub("0", w) for w in _words(text)]
    return (words[-2] if len(words) > 1 else "", words[-1] if words else "")
