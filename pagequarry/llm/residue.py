"""Problem 2: template residue, filler, error pages and notices that scripts are required.

Detectors look at what a page shows a reader outside code samples; whether a
message stands in place of the content or beside it is told by the main body
(problem 5). A body of low information, short or made of messages for the most
part, is compared with the terms of its address and title, and with what the
addresses of its host and other hosts show.
"""

from __future__ import annotations

import re
from urllib.parse import unquote, urlsplit

import xxhash

from pagequarry.llm import blocks
from pagequarry.llm.dom import Page

#: Placeholders that were not filled, or were filled with a bare object.
PLACEHOLDER = re.compile(
    r"\{\{\{?\s*[^\W\d][\w.\-]*(?:\s*\|\s*[\w:]+)*\s*\}?\}\}"  # {{name}}, {{ name | filter }}, {{{name}}}
    r"|[$#]\{\s*[^\W\d][\w.]*\s*\}"  # ${name}, #{name}
    r"|\{%-?\s*\w+[^%{}]*+%\}|<%[=\-]?\s*[^%<>\s][^%<>]*+%>"  # {% tag %}, <%= name %>
    r"|%%[A-Za-z_][\w.]*%%|@@[A-Za-z_][\w.]*@@|<<\s*[A-Za-z_][\w.]*\s*>>|\[%\s*[\w.]+\s*%\]"
    r"|\[(?:insert|enter|add|type|replace)\b[^\[\]\n]++\]|\[your\b[^\[\]\n]++\](?!\()"
    r"|\[object [A-Z]\w*\]"
    r"|(?<![\w\\}$^_{#%])\{(?:[^\W\d][\w.]*|\d{1,2})\}(?![\w{}])",  # {name}, {0}
    re.I,
)
START = re.compile(r"[{\[$#%@<]")
GREETED = re.compile(r"\b(?:dear|hello|hi|welcome back),? (?:undefined|null|none|nan)\b", re.I)
# The words of the common filler text and of its public continuations, and of other stopgaps.
FILLER_WORDS = frozenset(
    "a ac accumsan ad adipiscing adipisicing aenean aliqua aliquam aliquet aliquip amet anim ante arcu at auctor augue aute bibendum blandit cillum commodo condimentum congue consectetur consequat conubia convallis cras culpa "
    "cum cupidatat curabitur cursus dapibus deserunt diam dictum dictumst dignissim dis do dolor dolore donec duis ea efficitur egestas eget eiusmod eleifend elementum elit enim erat eros esse est et etiam eu euismod ex excepteur "
    "exercitation facilisis faucibus felis fermentum feugiat finibus fringilla fugiat fusce gravida habitant hendrerit iaculis id imperdiet in incididunt inceptos integer interdum ipsum irure justo labore laboris laborum lacinia "
    "lacus laoreet lectus leo libero ligula litora lobortis lorem luctus maecenas magna magnis malesuada massa mattis mauris maximus metus mi minim molestie mollis mollit montes morbi mus nam nascetur natoque nec neque netus nibh nisi "
    "nisl non nostra nostrud nulla nullam nunc occaecat odio officia orci ornare pariatur parturient pellentesque penatibus per pharetra phasellus placerat porta porttitor posuere potenti praesent pretium primis proident proin pulvinar "
    "purus quam qui quis quisque reprehenderit rhoncus ridiculus risus rutrum sagittis sapien scelerisque sed sem semper senectus sint sit sociis sodales sollicitudin suscipit suspendisse taciti tellus tempor tempus tincidunt torquent "
    "tortor tristique turpis ullamco ullamcorper ultra ultrices ultricies urna ut varius vehicula vel velit venenatis veniam vestibulum vitae vivamus viverra volutpat voluptate vulputate "
    "asdf blah blindtext qwerty tbd test text todo xxx xxxx".split()
)
FILLER_PHRASE = re.compile(
    r"your (?:text|content|heading|title|copy) (?:goes )?here|(?:sample|dummy|filler|placeholder) (?:copy|text|content) (?:for|goes|only|here)|write something about|type a short|replace this (?:paragraph|text|sentence)|(?:click|tap) (?:here )?to edit|add your (?:own )?text|edit this text|text goes here"
    r"|texto de (?:relleno|ejemplo)|hier steht ihr text|blindtext|texte provisoire|faux texte|testo segnaposto|ダミーテキスト",
    re.I,
)
#: Words that real sentences hold in the languages of the corpus; filler has none.
FUNCTION = frozenset("the of and to a an is are with for by which that it its der die das und ein eine ist von mit für le la les de du des et est que un une el los las y en por con si sin para il o os as do da".split())
ERROR = re.compile(
    r"\b(?:error|http|status) ?[45][0-5]\d\b|^\W*[45][0-5]\d\b|not found|no longer (?:available|exists)|(?:does|did) not exist|doesn't exist|(?:has|have|was|were) (?:been )?(?:removed|deleted|moved)|never existed|could not be found|can(?:no|')t be found"
    r"|page missing|nothing here|\blost\?|leads nowhere|(?:link|page|session) (?:has )?(?:expired|timed out)|timed out|\bgone\b|forbidden|unauthori[sz]ed|access (?:is )?denied|permission to|not allowed|do not have the rights|barred from|was blocked|(?:is|are) blocked"
    r"|security check|restricted area|sign-?in is needed|(?:log|sign) in to (?:view|continue|see)|human visitor|you are (?:a )?human|captcha|too many requests|slow down|server error|bad gateway|gateway time-?out|unavailable|temporarily offline|overloaded"
    r"|try again later|reload the page|went wrong|something broke|uncaught|exception|application error|database|unexpected problem|invalid response|failed with status|not able to handle|did not answer|maintenance|\boops\b|\bwhoops\b|incident [0-9a-f]{6}"
    r"|nicht gefunden|existiert nicht|nicht (?:mehr )?verfügbar|zugriff verweigert|serverfehler|no encontrad[ao]|ya no existe|no existe|acceso denegado|error del servidor|introuvable|aucun document|n'existe (?:plus|pas)|accès refusé|erreur (?:interne|du serveur)"
    r"|não encontrad[ao]|non trovat[ao]|見つかりません|移動しました|存在しません|アクセスが拒否|エラー|غير موجودة|تم رفض",
    re.I | re.M,
)
#: Every phrase of ``ERROR`` holds one of these: what a text has none of need not be searched.
HINTS = (
    "error", "http", "status", "40", "41", "42", "43", "45", "49", "50", "51", "52", "53", "not found", "longer", "exist", "been", "removed", "deleted", "moved", "be found", "missing", "nothing here", "lost?", "leads nowhere", "expired",
    "timed out", "gone", "forbidden", "unauthori", "denied", "permission", "not allowed", "the rights", "barred", "blocked", "security check", "restricted area", "is needed", "to view", "to continue", "to see", "human", "captcha",
    "too many", "slow down", "gateway", "unavailable", "offline", "overloaded", "try again", "reload", "wrong", "something broke", "uncaught", "exception", "database", "unexpected problem", "invalid response", "failed with", "not able",
    "did not answer", "maintenance", "oops", "incident", "gefunden", "verfügbar", "verweigert", "serverfehler", "encontrad", "acceso", "introuvable", "aucun document", "accès", "erreur", "trovat", "見つかりません", "移動しました", "存在しません",
    "アクセスが拒否", "エラー", "غير موجودة", "تم رفض",
)
SCRIPT = re.compile(r"javascript|java script|\bjs\b|scripting|\bscripts?\b|client-side code|スクリプト", re.I)
SWITCH = re.compile(
    r"enabled?\b|turn(?:ed)? (?:it |them )?on|switch(?:ed)? (?:it |them )?(?:on|off)|required?|needs?\b|needed|must|disabled|blocked|allow|activ\w+|aktivier\w+|habilit\w+|nécessaire|erforderlich|benötigt|necesita|有効",
    re.I,
)
SENTENCE = re.compile(r"[^.!?。\n]+[.!?。]*")
#: A body of up to so many characters is of low information by its size, a longer one if half of it are messages.
SHORT, MESSAGES = 400, 0.5
TERM = re.compile(r"[^\W_]{3,}")


def _filler(s: str) -> bool:
    """Whether a block is filler: its phrases or words, or words that nothing binds."""
    words = re.findall(r"[^\W\d_]+", s)
    if len(words) >= 3 and len(FILLER_PHRASE.findall(s)) * 10 >= len(words):
        return True
    if len(words) < 4:
        return False
    low = [w.lower() for w in words]
    known = sum(w in FILLER_WORDS for w in low)
    sense = sum(w in FUNCTION and w not in FILLER_WORDS for w in low)
    if known >= 0.5 * len(low) and sense * 8 <= len(low):
        return True
    # Low information: many words, none that binds them, some known and many that recur.
    return len(low) >= 12 and not sense and s.isascii() and known >= 0.3 * len(low) and len(set(low)) < 0.8 * len(low)


def _message_shares(text: str) -> tuple[float, float]:
    """The shares of a text that stand in sentences with an error phrase, and in such that ask for scripts.

    A sentence that only names scripts, beside one that only says what to do, is such a request too.
    """
    low = text.lower()
    hints = [h for h in HINTS if h in low]
    scripts = SCRIPT.search(text) is not None
    if not hints and not scripts:
        return 0.0, 0.0
    whole = error = notice = 0
    last, last_script, last_switch, last_notice = 0, False, False, False
    for m in SENTENCE.finditer(text):
        s = m[0].strip()
        if not s:
            continue
        whole += len(s)
        low = s.lower()
        if any(h in low for h in hints) and ERROR.search(s):
            error += len(s)
        if not scripts:
            continue
        script, switch = SCRIPT.search(s) is not None, SWITCH.search(s) is not None
        now = (script or last_notice or last_script) and switch
        if now or (script and last_switch):
            notice += len(s)
            if not last_notice and not (script and switch):
                notice += last
            now = True
        last, last_script, last_switch, last_notice = len(s), script, switch, now
    return (error / whole, min(1.0, notice / whole)) if whole else (0.0, 0.0)


def detect(page: Page, address: str, title: str) -> dict:
    """What the detectors find on a page.

    ``match`` is the share of the terms of address and title that its body holds. Where these have none, the terms
    are those of the page's own title, which a body made of messages never fits; null where it has none either.
    """
    items, _, body = blocks.classify(page)
    shown = [(b, page.prose(i)) for i, b in zip(items, body) if page.tag[i] not in ("pre", "code")]
    every = " \n".join([page.title, *(s for _, s in shown)])
    main = [s for b, s in shown if b and s]
    code = any(b and page.tag[i] in ("pre", "code") for i, b in zip(items, body))
    text = "\n".join(main)
    chars = len(text)
    errors, notices = _message_shares(text)
    short = chars > 0 and not code and (chars <= SHORT or errors >= MESSAGES)
    slug = unquote(urlsplit(address).path.rstrip("/").rpartition("/")[2]) if address else ""
    wanted = {w.lower() for w in TERM.findall(slug.replace("-", " ") + " " + title) if not w.isdigit()} - {"item", "page", "index", "html"}
    known = bool(wanted)  # else the page's own title must do, and messages need not fit it
    wanted = wanted or {w.lower() for w in TERM.findall(page.title)}
    terms = {w.lower() for w in TERM.findall(text)} if wanted and short and (known or errors < MESSAGES) else set()
    return {
        "placeholder": any(PLACEHOLDER.match(every, m.start()) for m in START.finditer(every)) or GREETED.search(every) is not None,
        "filler": any(_filler(s) for s in main),
        "notice": not code and (notices >= MESSAGES if chars else _message_shares(" ".join(page.noscript))[1] > 0),
        "errors": len({m[0].lower() for m in ERROR.finditer(text + "\n" + page.title)}) if short else 0,
        "short": short,
        "match": len(wanted & terms) / len(wanted) if wanted else None,
        "chars": chars,
        "print": xxhash.xxh64_intdigest(re.sub(r"[0-9a-f]{6,}|\d+|/\S+", "0", text.lower()).encode("utf-8", "surrogatepass")) - (1 << 63),
    }
