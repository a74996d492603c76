"""Template residue and error-page text.

Texts are cut into lines and sentences; their normalised forms are counted by host (the
source a text came from). What recurs in most documents of a host is that site's own
boilerplate and is subtracted. A text whose residual holds evidence of an unfilled
placeholder, of filler, of an error page or of a notice that scripts are needed is
reported. Evidence is a construction, not a phrase: a subject with its failure, a verb of
enabling with a script and a purpose, a delimiter with a field's name. Talk of errors,
scripts or templates as part of the work lacks one part of it, or has a verb of work.

An automaton of trigger words passes over each text once; only lines that hold a trigger
are tested, and only for that trigger's class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sightline.session import cut_table, spread

# HTML elements, which are markup and no placeholders.
TAGS = r"(?:a|abbr|article|b|blockquote|body|br|button|center|code|col|dd|div|dl|dt|em|figure|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|label|li|link|main|meta|nav|ol|option|p|pre|script|section|select|small|span|strong|style|sub|sup|svg|table|tbody|td|th|thead|title|tr|u|ul)"
# Words that name the fields of a vacancy's template.
_FIELD = r"(?:company|employer|job|position|role|city|location|country|region|salary|range|start|end|closing|hiring|line|manager|reporting|reports|to|contract|type|benefits?|department|team|first|last|full|contact|name|title|apply|application|url|link|e-?mail|phone|number|address|date|currency|amount|years?|hours|experience|skills?|description|logo|requirements|responsibilities|ansprechpartner|datum|ort|stelle|firma|gehalt|abteilung|standort|poste|entreprise|lieu|ville|salaire|intitulé|nom|date|du|de|la|l'entreprise)"
FIELDS = rf"(?:{_FIELD}(?:[ _-]{_FIELD}){{0,4}})"

# What scripts are called, how they are switched on, and what for.
SCRIPTS = r"(?:java ?scripts?|js|scripting|(?:client-side |the )?scripts)(?: (?:and|&) cookies)?|cookies and (?:java ?script|js|scripts?)"
_ON = r"(?:re-?)?(?:enable|activate|turn on|switch on|allow|unblock|permit)"
_STATE = r"(?:enabled|allowed|active|activated|permitted|turned on|switched on)"
_OFF = r"(?:off|disabled|blocked|deactivated|turned off|switched off|not (?:enabled|supported|available|running|allowed))"
_PURPOSE = r"(?:to (?:view|see|use|run|apply|continue|load|access|show|open|read|display|proceed|browse|render|start|submit|work)|before|in order to|so that|for (?:this|the) (?:site|page|app|form)|and (?:reload|refresh|retry|try|then))"
_VIEWER = r"(?:site|page|app|application|website|web ?page|portal|form|viewer|content|tool|widget)"
# What fails on an error page, and the ways it fails.
_SUBJECT = r"(?:page|job|posting|vacancy|listing|position|advert|advertisement|ad|opening|link|url|document|file|resource|site|website|server|service|host|domain|database|session|token|login|request|connection|portal|gateway|upstream|certificate|content)"
_FAILS = (
    r"(?:(?:can ?not|can't|could not|couldn't) be (?:found|displayed|loaded|reached|opened|shown|processed|completed|located|accessed|established|verified)"
    r"|(?:is|was|are|were)?(?: ?currently| ?temporarily)? ?not (?:found|available|configured|responding|reachable|accessible)|(?:does ?n[o']t|does not|doesn't|no longer) exists?|(?:is |are )?no longer (?:available|active|online|open|published|listed|accepting applications)"
    r"|(?:is|are|was)?(?: ?currently| ?temporarily)* ?(?:unavailable|unreachable|offline|overloaded)|(?:has |have |is |was )?(?:been )?(?:timed out|expired|blocked|taken down|terminated|withdrawn)|(?:has|have|may have|might have) been (?:removed|deleted|moved|closed|archived|unpublished)|(?:connection )?(?:failed|refused|reset)(?: by| to|\W*$))"
)
# A sentence about work with failures, not one that reports a failure.
WORK = re.compile(r"\b(?:must|shall|should|never|handl\w+|fix\w*|resolv\w+|debug\w*|investigat\w+|monitor\w*|reduc\w+|prevent\w*|troubleshoot\w*|difference between|experience (?:with|in|of)|knowledge of|such as|e\.g\.|for example|responsible for|you (?:will|test|read|replace|write|keep|answer|analy[sz]e|check|report|log)|employees?|applicants?|candidates? (?:must|should|who)|sie (?:beheben|pflegen|prüfen|bearbeiten)|vous (?:corrigez|gérez|traitez|vérifiez))\b")
# Reason phrases of HTTP.
_REASON = r"(?:bad request|unauthori[sz]ed|payment required|forbidden|(?:page |file |resource |job )?not found|method not allowed|not acceptable|proxy authentication required|request time-?out|gone|payload too large|unsupported media type|too many requests|unavailable for legal reasons|internal server error|server error|not implemented|bad gateway|service (?:temporarily )?unavailable|temporarily unavailable|gateway time-?out|access denied)"
_EMPTY = [":undefined", ": undefined", ":null", ": null", ":nan", ": nan", ":none", ": none"]
_KEYS = ["asdf", "sdfg", "dfgh", "fghj", "ghjk", "hjkl", "qwer", "uiop", "zxcv", "xcvb", "cvbn"]
_SHORT_LATIN = ["sed", "sit", "ut", "et", "do", "ad", "ex", "ea"]
_LATIN = r"(?:dolor|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|dolore|magna|aliqua|enim|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|commodo|consequat|lorem|ipsum|sit|ut|et|do|ad|ex|ea)"
_FILL_VERBS = ["enter", "add", "insert", "type", "write", "paste", "fill in", "fill out", "put", "list", "describe", "provide", "specify", "complete", "edit", "replace"]
_FILLS = f"(?:{'|'.join(_FILL_VERBS)})"

#: Constructions by class as (triggers, form): a line that a form matches holds one of its triggers, all lower case.
FORMS: dict[str, list[tuple[list[str], str]]] = {
    "placeholder": [
        (["{{"], r"\{\{[^{}]+\}\}"), (["${"], r"\$\{[^{}]+\}"), (["<%"], r"<%=?[^%]+%>"), (["{%"], r"\{%[^%{}]+%\}"), (["{!"], r"\{![\w .]+\}"), (["[["], r"\[\[[^\[\]]+\]\]"), (["@@"], r"@@\w{2,}@@"), (["##"], r"##\w{2,}##"), (["*|"], r"\*\|[^|]+\|\*"),
        (["%("], r"%\(\w{2,}\)s"), (["$"], r"(?<![\w$])\$[a-z]+(?:_[a-z]+)*\$"), (["{"], r"(?<![\w{])\{\d\}(?!\w)"), (["{"], rf"(?<!\{{)\{{{FIELDS}\}}"), (["{"], r"\{[a-z]+(?:_[a-z]+)+\}"),
        (["<"], rf"<<?(?!{TAGS}\b|/|!|\||(?:noscript|error|xml|json|sql|message|requestid)\b)[a-z][a-z_]*(?: [a-z_]+){{0,3}}>"), (["["], rf"\[{FIELDS}\]"), ([b + x for b in "[(" for x in [*_FILL_VERBS, "your", "please", "bitte"]], rf"[\[(](?:please |bitte )?(?:{_FILLS}|your) [^\])]+[\])]"), (["["], r"\[[^\[\]]+ (?:to be (?:added|confirmed|defined|completed|announced)|einfügen|eintragen|ergänzen|ausfüllen|here)\]"), (["["], r"\[(?:insérer|indiquer|saisir|ajouter|renseigner|préciser|intitulé|nom de)[^\[\]]*\]"), (["["], r"\[(?:أدخل|اسم|يحد|يُحد|أضف|اكتب)[^\[\]]*\]"),
        (["[object object]"], r"\[object object\]"), (["nan -", "nan-", "nan –", "nan–"], r"\bnan ?[-–] ?nan\b"), (_EMPTY[:6], r"\w ?: ?(?:undefined|null|nan)\b\W*$"), (_EMPTY, rf"\b{FIELDS} ?: ?(?:undefined|null|nan|none)\b(?! (?:of|is|are|needed))"), (["undefined", "null"], r"\b(?:to|at|join|next|new|dear|hello|hi|with|by) (?:undefined|null)\b(?! (?:hypothes|behavio|value|pointer|check|type|safety|and|or)\w*)"),
    ],
    "filler": [
        (["lorem"], r"\blorem ipsum\b"), (["dolor", "amet", "consectetur", "adipiscing", "elit", "sed", "eiusmod", "tempor", "incididunt", "labor", "magna", "aliq", "enim", "minim", "veniam", "quis", "nostrud", "exercitation", "ullamco", "nisi", "commodo", "consequat", "lorem", "ipsum", *(f"{a}{x}{b}{y}" for a in _SHORT_LATIN for x in (" ", ", ", ". ") for b in _SHORT_LATIN for y in " ,.")], rf"\b(?:{_LATIN}(?:[,.]? |[,.])){{5,}}"),
        (["blah"], r"\bblah\W+blah"), (_KEYS, rf"\b(?:(?:{'|'.join(_KEYS)})\w*\b[ !.,]*){{2,}}|^\W*(?:{'|'.join(_KEYS)})\w*\W*$"),
        (["sample", "dummy", "placeholder", "filler", "demo ", "temporary", "example"], r"(?:^|[.:!|-])\W*(?:this is )?(?:an? |the |some )?(?:sample|dummy|placeholder|filler|demo|temporary|example) (?:text|content|copy|paragraph|description)\b(?= ?(?:$|[.,;:!|–-]|for|goes|here|to be|only|please|sample|will|until|used))|\bthis is (?:an? |the |some )?(?:sample|dummy|placeholder|filler|demo|temporary|example) (?:text|content|copy|paragraph|description)\b"), (["here"], r"\b(?:text|description|content|copy|title|summary|details) (?:goes|comes|to go|will go) here\b"), (["here", "below", "per line", "this field", "this box", "this section"], rf"^[^a-z]*(?:[\w ]{{1,40}}[|:] )?(?:please )?{_FILLS} .{{2,80}}?\b(?:here|below|(?:one )?per line|in this (?:field|box|section))\W*$"), (["here", "below", "per line"], rf"\b(?:please )?{_FILLS} (?:the |your |a |some )?(?:[\w-]+ )?(?:description|text|title|content|responsibilities|requirements|summary|details|duties|skills|benefits|name),? (?:here|below|one per line|per line)\b(?! \d)"),
        (["replace me", "delete me", "replace this", "delete this", "remove this", "edit this", "overwrite this", "change this"], r"\b(?:replace|delete) me\b|\b(?:replace|delete|remove|edit|overwrite|change) this (?:text|line|placeholder|paragraph|section|description|content)\b"), (["todo"], r"^\W*todo\b\W"), ([c * 3 for c in "abcdefghijklmnopqrstuvwxyz"], r"\b([a-z])\1{2,}\b[\s,.!-]+([a-z])\2{2,}\b"),
        (["mustertext", "blindtext", "platzhaltertext", "beispieltext", "fülltext"], r"(?:^|[.:!|-])\W*(?:mustertext|blindtext|platzhaltertext|beispieltext|fülltext)\b|\b(?:dies|das|hier) (?:ist|steht|kommt) (?:ein )?(?:mustertext|blindtext|platzhaltertext|beispieltext|fülltext)\b|\b(?:mustertext|blindtext|platzhaltertext|beispieltext|fülltext) (?:für die|bitte|hier)\b"), (["einfügen", "eintragen", "ergänzen", "ersetzen"], r"\b(?:hier|text|beschreibung)\b.{0,30}\b(?:einfügen|eintragen|ergänzen)\b|\bbitte (?:diesen text )?ersetzen\b"), (["texte"], r"\b(?:faux[- ]texte|texte (?:d.exemple|à remplacer|factice|provisoire|de remplissage|temporaire))\b"), (["saisir", "saisissez", "insérez", "ajoutez"], r"^\W*(?:saisir|saisissez|insérez|ajoutez)\b.{2,60}\bici\b"),
        (["نص "], r"نص (?:تجريبي|مؤقت|عشوائي|نموذجي|بديل|افتراضي)"), (["هنا"], r"(?:اكتب|أدخل|أضف|ضع) .{2,40}هنا"),
    ],
    "error": [
        (["found", "forbidden", "unauthori", "payment required", "not allowed", "not acceptable", "authentication required", "time", "gone", "too large", "unsupported", "too many", "legal reasons", "server error", "not implemented", "gateway", "unavailable", "bad request", "denied"], rf"\b(?:error |status |code |http )*[45]\d\d\b(?: error)?\W{{0,4}}(?:the |requested )?{_REASON}\b"), (["found", "forbidden", "unauthori", "payment required", "not allowed", "not acceptable", "authentication required", "time", "gone", "too large", "unsupported", "too many", "legal reasons", "server error", "not implemented", "gateway", "unavailable", "bad request", "denied"], rf"^\W*(?:[^|]{{0,60}}\| *)?(?:error\W+)?{_REASON}\W*(?:[45]\d\d)?\W*$"),
        (["<title"], r"<title>[^<]*(?:not found|forbidden|error|unavailable|gateway|denied)"), (["internal server", "bad gateway", "gateway time", "too many req", "rate limit", "service unavail", "service temp"], r"\b(?:internal server error|bad gateway|gateway time-?out|too many requests|rate limit (?:exceeded|reached)|service (?:temporarily )?unavailable)\b"), (["error", "fehler", "erreur", "خطأ"], r"^\W*(?:http |server )?(?:error|fehler|erreur|خطأ)\W{0,3}(?:code )?[45]\d\d\b\W*(?:[:|–-]|$)"),
        (["found", "displayed", "loaded", "reached", "opened", "shown", "processed", "completed", "located", "accessed", "established", "verified", "available", "configured", "responding", "reachable", "accessible", "exist", "no longer", "unavailable", "offline", "overloaded", "timed out", "expired", "blocked", "taken down", "terminated", "withdrawn", "removed", "deleted", "moved", "closed", "archived", "unpublished", "failed", "refused", "reset"], rf"\b{_SUBJECT}s?\b(?:\W+(?!to\b)[\w'-]+){{0,4}}?\W+{_FAILS}"), (["removed", "deleted", "moved"], r"\bit (?:may|might) have been (?:removed|deleted|moved)\b"),
        (["denied", "forbidden", "refused", "restricted", "blocked", "rejected"], r"\b(?:access|permission)(?: (?:is|was|has been))? (?:denied|forbidden|refused|restricted)\b(?! (?:without|unless|if|to anyone|for))|\brequest (?:was |has been |is )?(?:blocked|denied|rejected|refused)\b"), (["permission", "authori", "allowed", "permitted to"], r"\byou (?:don't|do not|are not|aren't) (?:have (?:the |sufficient )?permissions?|authori[sz]ed|allowed|permitted) to (?:access|view|see|open|use)\b"), (["permission to"], r"\byou don't have permission to\b"),
        (["went wrong", "occurred", "oops"], r"\bsomething went wrong\b|\b(?:an|some|this) (?:[\w-]+ )?error (?:has |have )?occurred\b|\bhas occurred\W+(?:reference|error|code)|^\W*oops\b"), (["we can", "we could", "we were unable", "unable to"], r"\bwe (?:can ?not|can't|could not|couldn't|were unable to) (?:find|load|locate|display|show|process|complete|open|reach|retrieve)\b|^\W*(?:sorry\W+)?unable to (?:load|display|find|connect|process|complete|retrieve|resolve|reach)\b"), (["you are looking for", "you were looking for", "you requested", "you tried"], r"\bthe (?:page|job|url|file|resource|document|posting) you (?:are looking for|were looking for|requested|tried)\b"),
        (["try again", "log in", "sign in", "reload", "refresh"], r"\bplease try again\b|\btry again (?:later|shortly|soon|in a)|\bplease (?:log|sign) in (?:again|to (?:continue|view|see|access|proceed))|\b(?:log|sign) in again\b|\bplease (?:reload|refresh) (?:the|this) page\b|\b(?:reload|refresh) (?:the|this) page (?:and|or|to)\b"), (["back shortly", "back soon", "back online", "coming soon"], r"\b(?:we'?(?:ll| will)|we will|will) be back (?:shortly|soon|online)\b|^\W*coming soon\W*$"),
        (["construction"], rf"\b{_VIEWER}s? (?:is |are )?(?:currently )?under construction\b|^\W*under construction\W*$"), (["down for", "undergoing", "under maintenance", "under scheduled", "under planned", "under routine", "under urgent", "scheduled maintenance", "planned maintenance"], r"\b(?:down for|undergoing)(?: \w+)? maintenance\b|\b(?:site|page|system|service|portal|server|website)s?(?: \w+){0,2} under(?: scheduled| planned| routine| urgent)? maintenance\b|^\W*(?:scheduled|planned) maintenance\W*$"), (["timeout after"], r"\btimeout after \d+"),
        (["traceback", "stack trace", "exception in"], r"\btraceback \(most recent|\bstack trace:|\bexception in thread\b"), (["exception", "error"], r"\b(?:[a-z_$][\w$]*\.){2,}[\w$]*(?:exception|error)\b|\b[a-z]{2,}(?:error|exception): "), ([".java", ".kt", ".scala", ".py", ".js", ".ts", ".php", ".cs", ".rb", ".go", "native method", "unknown source", "\", line "], r"\bat (?:[\w$]+\.)+[\w$<>]+\((?:\w+\.(?:java|kt|scala|py|js|ts|php|cs|rb|go)(?::\d+)?|native method|unknown source)\)|\bfile \"[^\"]+\", line \d+"), (["fatal error", "parse error", "syntax error", "uncaught ", "sqlstate", "segmentation fault", "call to undefined", "undefined index", "undefined variable"], r"\b(?:fatal|parse|syntax) error[:,]|\buncaught \w+(?:error|exception)?\b|\bsqlstate\b|\bsegmentation fault\b|\bcall to undefined\b|\bundefined (?:index|variable)\b"),
        (["\"error", "'error", "<error"], r"[\"']error(?:s|_?code|_?message)?[\"'] ?:|<error>"), ([f"/{n}" for n in range(10)], r"^\W*[a-z][\w-]*/\d+(?:\.\d+)+\W*(?:\(\w+\))?\W*$"), (["you are human", "you are a human", "you are not a", "you're human", "you're a human", "you're not a", "your browser", "captcha", "unusual traffic", "ray id"], r"\b(?:verify|verifying|confirm|prove|check|checking)(?: that)? you(?:'re| are) (?:(?:a )?human|not a (?:robot|bot|machine))\b|\bchecking your browser\b|\bcomplete the captcha\b|\bunusual traffic\b|\bray id\b"),
        (["nicht gefunden", "verfügbar", "erreichbar", "vorhanden", "existiert", "abgelaufen", "verweigert", "gesperrt", "fehlgeschlagen", "gelöscht", "entfernt", "im aufbau"], r"\b(?:seite|stelle|anzeige|stellenanzeige|angebot|dienst|server|link|verbindung|sitzung|zugriff|datei|inhalt)\b(?:\W+[\w'-]+){0,4}?\W+(?:nicht gefunden|nicht (?:mehr )?(?:verfügbar|erreichbar|vorhanden)|existiert nicht|abgelaufen|verweigert|gesperrt|fehlgeschlagen|gelöscht|entfernt|im aufbau)\b|\bnicht mehr verfügbar\b"), (["fehler", "schief", "wartungsarbeiten", "versuchen sie es"], r"\b(?:ein|interner|unbekannter|unerwarteter)(?: \w+)? ?fehler (?:ist )?(?:aufgetreten|passiert)\b|\binterner serverfehler\b|\betwas ist schief\w*|\bwegen wartungsarbeiten\b|\bversuchen sie es (?:später|erneut)"),
        (["introuvable", "existe", "non trouvé", "indisponible", "expiré", "refusé", "interdit", "inaccessible", "supprimé", "disponible", "accessible", "en maintenance", "en construction"], r"\b(?:page|offre|annonce|service|site|lien|session|serveur|accès|connexion|contenu|poste|fichier)\b(?:\W+[\w'-]+){0,4}?\W+(?:introuvable|n'existe (?:pas|plus)|non trouvée?|indisponible|expirée?|refusée?|interdite?|inaccessible|supprimée?|n'est (?:pas|plus) (?:disponible|accessible)|en maintenance|en construction)|\btemporairement indisponible\b"), (["erreur", "réessay"], r"\bune erreur (?:\w+ )?(?:est survenue|s'est produite)\b|\berreur interne\b|\bveuillez réessayer\b|\bréessayez plus tard\b"),
        (["خطأ"], r"حدث خطأ|خطأ (?:في الخادم|داخلي|غير متوقع|\d+ ?:)"), (["غير ", "العثور", "انتهت", "تم حذف", "تعذر", "قيد ", "مرفوض", "محظور", "لا يمكن"], r"(?:الصفحة|الوظيفة|الإعلان|الخدمة|الرابط|الجلسة|الموقع|الخادم|الطلب|الوصول)(?:\s+\S+){0,3}?\s+(?:غير (?:موجود|متاح|صحيح|متوفر)\w*|قيد (?:الصيانة|الإنشاء)|مرفوض|محظور)|لم يتم العثور على|انتهت (?:الجلسة|صلاحية)|تم حذف (?:هذا|هذه) |تعذر (?:تحميل|الوصول|عرض)|لا يمكن (?:عرض|تحميل|الوصول إلى) (?:الصفحة|هذه)"), (["حاول مرة", "المحاولة"], r"(?:حاول مرة أخرى|يرجى المحاولة)"),
    ],
    "script": [
        (["script", "scripting", "js", "cookies"], rf"\b{_ON} (?:your |the )?(?:{SCRIPTS})(?: (?:in|on|for|within) (?:your|the|this) (?:\w+ )?\w+)?,?(?: please)? {_PURPOSE}\b"), (["script", "scripting", "js", "cookies"], rf"\b{_ON} (?:your |the )?(?:{SCRIPTS}) (?:in|on|within) (?:your|the|this) (?:web )?browser\b"), (["script", "scripting", "js", "cookies"], rf"\b(?:please|kindly|must|need to|have to|should|to) (?:first )?{_ON} (?:{SCRIPTS}|cookies)\W*(?:$|[.!,;|])"), (["script", "scripting", "js", "cookies"], rf"\bto [a-z]+\b[^.]{{0,60}}, (?:please )?{_ON} (?:{SCRIPTS})\b"), (["script", "scripting", "js", "cookies"], rf"\b(?:{SCRIPTS}) (?:must|needs? to|has to|have to|should) be {_STATE}\b"),
        (["script", "scripting", "js", "cookies"], rf"\b(?:{SCRIPTS}) (?:is|are|seems? to be|appears? to be|has been|was) (?:currently )?{_OFF}\b"), (["script", "scripting", "js", "cookies"], rf"\bwithout (?:{SCRIPTS}),? (?:we|this|the|you|it)\b"), (["script", "scripting", "js", "cookies"], rf"\b{_VIEWER} (?:requires?|needs|relies on|depends on|works only with|only works with|will not (?:load|work|run|open) without|does(?: not|n't) (?:load|work|run) without|(?:can ?not|can't) (?:load|work|run|be shown|be displayed|be opened) without) (?:a browser with )?(?:{SCRIPTS})\b"),
        (["script", "scripting", "js", "cookies"], rf"\b(?:{SCRIPTS})(?: (?:is|are))? (?:required|needed|necessary) (?:to (?:view|use|load|see|run|display|access|open|continue)|for (?:this|the) {_VIEWER})\b"), (["browser"], r"\b(?:your |this )?browser (?:is (?:not supported|unsupported|outdated|too old)|does(?: not|n't) support (?:java ?script|scripts))\b|\byour browser has (?:java ?script|scripts?) (?:disabled|turned off|switched off)\b"), (["after enabling", "once enabled", "after you enable", "once you enable"], r"\b(?:reload|refresh|return|retry)\b.{0,30}\b(?:after enabling|once enabled|(?:after|once) you enable)\b"), (["<noscript"], r"<noscript>"), (["script"], r"\b(?:java ?script|scripts?)\b[^.]{0,20} switched off\b"),
        (["javascript", "skripte", "cookies"], r"\b(?:aktivieren|erlauben|schalten) sie (?:bitte )?(?:javascript|skripte|cookies)\b|\bbitte\b[^.]{0,40}\b(?:javascript|skripte)\b[^.]{0,30}(?:aktivier|einschalt|erlaub|zulass)\w*|\bjavascript (?:ist|wurde) (?:deaktiviert|ausgeschaltet|blockiert)\b|\bjavascript muss aktiviert\b"), (["javascript", "scripts", "cookies"], r"\b(?:activer|activez|autoriser|autorisez|réactiver)\b[^.]{0,20}\b(?:javascript|scripts|cookies)\b|\bjavascript (?:est|semble) (?:désactivé|bloqué)|\bjavascript doit être activé|\bjavascript est (?:requis|nécessaire) pour (?:afficher|utiliser|voir)"), (["سكريبت", "javascript"], r"(?:تفعيل|تمكين|تشغيل|فعّل) (?:\S+ )?(?:جافا ?سكريبت|السكريبت|javascript)"),
    ],
}
#: Forms in which case tells a placeholder from prose; their triggers are as above.
CASED: list[tuple[list[str], str]] = [([f"%{c}" for c in "abcdefghijklmnopqrstuvwxyz"], r"%[A-Z][A-Z]*_?[A-Z_]+%"), (["__"], r"(?<!\w)__[A-Z][A-Z_]+__(?!\w)"), (["{"], r"\{[a-z]+[A-Z]\w*\}")]
#: Forms that may reach over a line's end (a title and its body), tested on whole texts.
ACROSS = {FORMS["error"][0][1], FORMS["error"][2][1], FORMS["filler"][1][1]}
#: Classes whose forms a verb of work refutes.
_REFUTABLE = {"error"}
_WORD = re.compile(r"\w+")
_CLAUSE = re.compile(r"[.;:|!?\n]")
#: Lines and sentences: breaks, block elements, ends of sentences.
BREAKS = re.compile(r"(?i)\r?\n|</?(?:p|li|ul|ol|div|br|h[1-6]|tr|td|hr|title|head|body|html|center|pre)\b[^>]*>|(?<=[.!?؟…])\s+")
_TAG = re.compile(rf"(?i)</?{TAGS}(?:\s[^<>]*)?/?>|<!--.*?-->|<!\w[^<>]*>")
_ODD = dict.fromkeys("\u00a0\u2007\u2009\u202f\u3000", " ") | dict.fromkeys("\u200b\u200e\u200f\ufeff", "") | dict.fromkeys("’‘", "'")
_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
_WORDY = re.compile(r"[^\W_]")


def opened(text: str) -> str:
    """The text with escaped markup opened and odd spaces plain, for matching only."""
    if "&" in text:
        for entity, char in _ENTITIES:
            text = text.replace(entity, char)
    if not text.isascii():
        for odd, char in _ODD.items():
            if odd in text:
                text = text.replace(odd, char)
    return text


def doubled(low: str) -> bool:
    """Whether a word of three letters or more stands three times in a row."""
    raw = low.split()
    if not any(map(eq, raw, raw[1:])):
        return False
    words = _WORD.findall(low)
    return any(a == b == c and len(a) > 2 for a, b, c in zip(words, words[1:], words[2:]))


def refuted(low: str, found: re.Match) -> bool:
    """Whether the clause around a finding has a verb of work, which makes it talk of failures."""
    before = _CLAUSE.split(low[max(0, found.start() - 60) : found.start()])[-1]
    after = _CLAUSE.split(low[found.end() : found.end() + 40])[0]
    return bool(WORK.search(before + found.group() + after))


class Detector:
    """The automaton of triggers and the forms behind them."""

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        self.forms: list[tuple[str, re.Pattern, bool]] = []
        at: dict[str, set[int]] = {}
        for kind, forms in FORMS.items():
            for triggers, form in forms:
                self._add(at, kind, triggers, re.compile(form), False)
        for triggers, form in CASED:
            self._add(at, "placeholder", triggers, re.compile(form), True)
        for trigger, numbers in at.items():
            self.automaton.add_word(trigger, frozenset(numbers))
        self.automaton.make_automaton()
        self.anchored = [bool(re.search(r"(?<![\\\[])\^|(?<!\\)\$(?=[|)]|$)", p.pattern)) for _, p, _ in self.forms]
        self.across = [i for i, (_, p, _) in enumerate(self.forms) if p.pattern in ACROSS]

    def _add(self, at: dict[str, set[int]], kind: str, triggers: list[str], form: re.Pattern, cased: bool) -> None:
        for t in triggers:
            at.setdefault(t, set()).add(len(self.forms))
        self.forms.append((kind, form, cased))

    def triggered(self, low: str) -> frozenset[int]:
        """The forms of which a text in lower case holds a trigger."""
        return frozenset().union(*{found for _, found in self.automaton.iter(low)})

    def line(self, line: str, hot: frozenset[int] | None = None) -> list[str]:
        """The classes of which one line holds evidence, sorted; ``hot`` are the forms that its text allows."""
        low = line.lower()
        out = {"filler"} if doubled(low) else set()
        for i in self.triggered(low) if hot is None else hot:
            kind, form, cased = self.forms[i]
            if kind not in out and any(kind not in _REFUTABLE or not refuted(low, m) for m in form.finditer(line if cased else low)):
                out.add(kind)
        return sorted(out)

    def read(self, text: str) -> tuple[list[tuple[str, list[str]]], list[str]]:
        """(distinct lines with their classes, classes of the evidence that only stands across lines)."""
        whole = opened(text)
        low = whole.lower()
        # A form without anchors that the whole text lacks is in none of its lines.
        hot = frozenset(i for i in self.triggered(low) if self.anchored[i] or self.forms[i][1].search(whole if self.forms[i][2] else low))
        if not hot and not doubled(low):
            return [], []
        lines = dict.fromkeys(x for part in BREAKS.split(whole) if (x := (_TAG.sub(" ", part) if "<" in part else part).strip()))
        read = [(x, self.line(x, hot)) for x in lines]
        if any(e for _, e in read):
            return read, []
        flat = " ".join(low.split()) if hot.intersection(self.across) else ""
        return read, sorted({self.forms[i][0] for i in self.across if i in hot and any(not refuted(flat, m) for m in self.forms[i][1].finditer(flat))})


@lru_cache(maxsize=1)
def detector() -> Detector:
    """The detector, built once per worker."""
    return Detector()


def normalised(line: str, evident: bool) -> int:
    """Hash of a line's normal form.

    Numbers in a line of evidence don't tell it from others; elsewhere a number may be a
    document's own, but words of letters and digits are references.
    """
    low = re.sub(r"\d+", "0", line.lower()) if evident else re.sub(r"\b(?:\d+[a-z]|[a-z]+\d)[a-z\d]*\b", "0", line.lower())
    h = xxh64_intdigest(re.sub(r"[\W_]+", " ", low).encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def _evident(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of the documents that hold any evidence: (k, h, n, e); n is null for evidence across lines."""
    find = detector()
    for b in batches:
        rows = []
        for k, h, t in zip(b["k"], b["h"], b["t"]):
            lines, across = find.read(t)
            if across or any(e for _, e in lines):
                rows += [(k, h, normalised(x, bool(e)), e) for x, e in lines if e or _WORDY.search(x)]
                rows += [(k, h, None, across)] if across else []
        out = pd.DataFrame(rows, columns=["k", "h", "n", "e"])
        yield out.astype({"n": "Int64"})


def find_residue(df: DataFrame, key: str, text: str, host: str, share: float = 0.5, least: int = 20) -> DataFrame:
    """(key, kinds) of the rows whose residual text holds evidence; kinds is a sorted array.

    A line is boilerplate if it stands in at least ``share`` of a host's documents and the host
    has ``least`` or more (in a host of one document each line stands in all of them). Documents
    are counted by distinct keys, however often a line or a row is repeated. A document of
    recurrent lines alone is no document with boilerplate but a page that recurs, and keeps its
    evidence. A line of evidence makes each document that holds it one with evidence, so that
    counting the lines of these documents counts it over all. Null, empty and blank texts hold
    nothing; repeated rows give one row; a null host is a host of its own; a text of any length
    is read whole.
    """
    kind, of = df.schema[key].dataType.simpleString(), df.schema[host].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("k"), F.col(host).alias("h"), F.col(text).alias("t"))).where(F.length("t") > 0)
    lines = cut_table(rows.mapInPandas(_evident, f"k {kind}, h {of}, n long, e array<string>"), "lines")
    per_host = df.select(F.col(host).alias("g"), F.col(key).alias("k")).distinct().groupBy("g").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least)
    stands = lines.where("n is not null").select("h", "n", "k").distinct().groupBy("h", "n").agg(F.count(F.lit(1)).alias("in"))
    recurrent = stands.join(per_host, F.col("h").eqNullSafe(F.col("g"))).where(F.col("in") >= share * F.col("docs")).select("g", F.col("n").alias("m"))
    marked = lines.join(recurrent, F.col("h").eqNullSafe(F.col("g")) & (F.col("n") == F.col("m")), "left")
    own = F.col("m").isNull()
    by_document = marked.groupBy("k", "h").agg(F.count_if(own).alias("own"), F.array_distinct(F.flatten(F.collect_set("e"))).alias("every"), F.array_distinct(F.flatten(F.collect_set(F.when(own, F.col("e"))))).alias("rest"))
    left = by_document.select("k", F.when(F.col("own") == 0, F.col("every")).otherwise(F.col("rest")).alias("e")).where(F.size("e") > 0)
    return left.groupBy("k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("e")))).alias("kinds")).withColumnRenamed("k", key)
