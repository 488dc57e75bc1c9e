"""What template residue, filler, error pages and script notices look like in English, German, French and Spanish."""

from __future__ import annotations

#: Characters and what stands for them; those without a counterpart, which have no width, are removed. Entities as they stand in texts that were escaped once too often.
PLAIN = ("｛｝\u00A0\u202F\u2009\u3000\u200B\u200C\u200D\u2060\uFEFF\u00AD", "{}    ")
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}

#: Names of fields that templates of records have; used only inside brackets that could also hold a note.
FIELDS = (
    "speaker", "name", "names", "first name", "surname", "last name", "title", "member", "minister", "party", "group", "constituency", "district", "date", "sitting", "day", "month", "year", "vote", "votes", "count", "total", "clause", "article", "number", "no", "id",
    "redner", "rednerin", "vorname", "nachname", "abgeordnete", "abgeordneter", "wahlkreis", "fraktion", "partei", "datum", "sitzung", "sitzungstag", "tag", "anzahl", "stimmen", "artikel", "nummer", "top-nr", "minister",
    "nom", "prénom", "orateur", "députe", "député", "groupe", "parti", "circonscription", "séance", "seance", "jour", "voix", "ministre", "numéro", "numero", "nb voix",
    "nombre", "apellido", "apellidos", "orador", "diputado", "grupo", "partido", "circunscripcion", "circunscripción", "fecha", "sesion", "sesión", "dia", "día", "votos", "ministro", "articulo", "artículo",
)

#: Words with which a template asks for what is missing.
ASKING = (
    "insert", "to be added", "to be confirmed", "to be completed", "to follow", "tbc", "tbd", "tba", "fill in", "placeholder",
    "einfügen", "ergänzen", "eintragen", "nachtragen", "folgt", "insérer", "à compléter", "à préciser", "à insérer", "insertar", "por completar", "por confirmar", "rellenar",
)

#: Slots whose delimiters only templates have.
SLOTS = (
    r"\{\{[^{}\n]++\}\}", r"\$\{[^{}\n]++\}", r"#\{[^{}\n]++\}", r"\{%[^{}\n]+%\}", r"<%=?[^<>\n]+%>", r"@@[^@\n]++@@", r"%\([^()\n]++\)[sd]", r"\$\([^()\n]++\)", r"\[\[[^\[\]\n]++\]\]", r"<<[^<>\n]++>>",
    r"__[\p{L}\d][^_\n]*(?:_[^_\n]+)*__", r"%\p{L}[\p{L}\d_. '’-]++%", r"\$\p{L}[\p{L}\d_. '’-]++\$", r"\|\p{L}[\p{L}\d_. '’-]++\|", r"[\[<{]\s*\p{L}+(?:[_.]\p{L}+)+\s*[\]>}]", r"_{3,}",
)

#: Bare slots: patterns of a date or a number where one should stand, in capitals as a template has them.
BARE = (
    r"\bXX[./-]XX[./-](?:20)?XX(?:XX)?\b", r"\b(?:[Dd]{2}|TT|tt|[Jj]{2})[./-][Mm]{2}[./-](?:[Yy]{4}|[Jj]{4}|[Aa]{4})\b", r"\b(?:DAY MONTH YEAR|TAG MONAT JAHR|JOUR MOIS ANN[EÉ]E|D[IÍ]A MES A[NÑ]O)\b", r"\b(?:NN|XX) (?:votes|Stimmen|voix|votos)\b",
    r"\b(?:FIRST NAME SURNAME|VORNAME NACHNAME|VORNAME NAME|PR[ÉE]NOM NOM|NOMBRE APELLIDOS?)\b",
)

#: Trusted passages: what web servers, frameworks, browsers and word processors in general use say, without case, digits and punctuation. They are written down from general knowledge of such notices, not from any
#: corpus; what a corpus says in other words is found from them by likeness and by company.
PHRASES = {
    "script": (
        "please enable javascript to view this page", "please enable javascript to continue", "please enable javascript in your browser", "javascript is disabled in your browser", "javascript is required to view this page", "javascript must be enabled to view this page", "this page needs javascript to run", "this site requires javascript",
        "you need to enable javascript to run this app", "you must enable javascript to use this site", "you need to turn on javascript to read this page", "your browser does not support javascript", "your browser does not run scripts so the page cannot be shown", "scripts are disabled in your browser", "scripts are blocked", "please use an up to date browser",
        "bitte aktivieren sie javascript um diese seite anzuzeigen", "javascript ist in ihrem browser deaktiviert", "javascript ist in ihrem browser ausgeschaltet", "diese seite benötigt javascript", "ihr browser unterstützt kein javascript", "ohne eingeschaltetes javascript kann die seite nicht dargestellt werden",
        "veuillez activer javascript pour afficher cette page", "le javascript est désactivé dans votre navigateur", "cette page nécessite javascript", "cette page requiert javascript", "cette page requiert l activation de javascript", "votre navigateur ne prend pas en charge javascript", "votre navigateur n exécute pas javascript", "sans javascript la page ne peut pas s afficher",
        "active javascript para ver esta página", "javascript está desactivado en su navegador", "esta página necesita javascript", "su navegador no admite javascript", "su navegador no ejecuta javascript", "sin javascript no es posible mostrar la página",
    ),
    "error": (
        "bad request", "unauthorized", "forbidden", "not found", "page not found", "gone", "request timeout", "internal server error", "bad gateway", "service unavailable", "gateway timeout", "too many requests", "access denied", "session expired", "something went wrong", "page unavailable", "connection refused", "connection timed out",
        "http bad request", "http forbidden", "http not found", "http gone", "http internal server error", "http bad gateway", "http service unavailable", "http gateway timeout", "http too many requests", "error not found", "error forbidden", "error bad gateway", "error service unavailable",
        "the page you requested could not be found on this server", "the requested url was not found on this server", "the server encountered an internal error and was unable to complete your request", "an unexpected condition was encountered while loading the page", "the server received an invalid response from the upstream server",
        "the service is temporarily unavailable", "please try again later", "please try again later or contact the administrator", "you do not have permission to view this page", "your session has expired please sign in again", "your session has timed out", "we are performing maintenance and will be back shortly", "please confirm that you are not a robot",
        "sorry this content is not available in your area", "the request was blocked by the firewall", "an unexpected error occurred while loading the page", "unable to connect to the database", "the link may be broken or the page may have been removed", "null pointer exception", "unhandled exception", "segmentation fault", "document could not be displayed", "retry in a few seconds",
        "seite nicht gefunden", "zugriff verweigert", "dienst nicht verfügbar", "interner serverfehler", "sitzung abgelaufen", "zeitüberschreitung", "die angeforderte seite wurde nicht gefunden", "keine verbindung zur datenbank", "der dienst steht vorübergehend nicht zur verfügung", "bitte versuchen sie es später erneut", "sie sind nicht berechtigt diese seite aufzurufen",
        "page introuvable", "accès refusé", "service indisponible", "erreur interne du serveur", "session expirée", "la page demandée est introuvable", "connexion à la base de données impossible", "le service est temporairement indisponible", "veuillez réessayer plus tard", "vous n êtes pas autorisé à accéder à cette page",
        "página no encontrada", "acceso denegado", "servicio no disponible", "error interno del servidor", "sesión caducada", "la página solicitada no existe", "no se pudo conectar con la base de datos", "el servicio no está disponible en este momento", "vuelva a intentarlo más tarde", "no tiene permiso para acceder a esta página",
    ),
    "filler": (
        "lorem ipsum dolor sit amet", "lorem ipsum dolor sit amet consectetur adipiscing elit", "sample text", "this is sample text and will be replaced", "this is a sample paragraph", "placeholder text for layout purposes only", "dummy text for layout purposes only", "text goes here", "your text here", "insert text here", "body text goes here",
        "dies ist ein blindtext", "dies ist ein blindtext und wird noch ersetzt", "hier steht später der text", "platzhaltertext", "platzhaltertext für das layout", "mustertext", "beispieltext",
        "ceci est un texte d exemple", "texte factice", "le texte viendra ici", "este es un texto de ejemplo", "texto de ejemplo", "texto simulado", "aquí irá el texto",
    ),
}

#: Words said over and over that are filler wherever they stand, and as whole passages.
SAID_AGAIN = r".*\b(?:test test test|essai essai|prueba prueba)\b.*|(?:bla ){3,}bla\b.*|lorem ipsum\b.*"
#: Of these, the words themselves.
REPEATED = ("test", "essai", "prueba", "bla")

#: Whole passages that stand alone only where a system wrote: a code of an HTTP error or a reference number, before digits are dropped.
CODES = r"(?:http |error |fehler |erreur |code )+[45]\d\d|[45]\d\d|(?:reference|referencia|référence|vorgangsnummer|incident|ticket):? *(?:no\.? ?|nr\.? ?)?[\dA-F]{2,}(?:-[\dA-F]{1,}){1,4}"
