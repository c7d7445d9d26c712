"""Template residue, filler, error pages and script notices, by mined message templates.

Every line of a text is cut into sentences, and those with any sign of residue
(an unfilled slot, a word of error pages, script notices or filler, or the
surroundings of an error page: a bar of links, a call to try again) become
messages: slots and numbers masked, in lower case.  A prefix tree of fixed
depth (number of tokens, then the first two) puts messages into leaves; within
a leaf, tokens that most messages share stay and the others become wildcards.
The resulting templates are few, and are classified once, over all the lines
they occur on, with signs or without: a template that mostly stands amid
prose, or that reports what
someone or something says, mentions such things and is no residue.  Verdicts
go back to the documents over the messages.

Results by case: null, empty and blank texts hold nothing; a text is searched
to its end whatever its length; repeated texts have the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.session import stage

#: Tokens of a message up to which its leaf is refined; longer sentences are templates of their own leaf.
LONG = 40
#: Share of a leaf's messages that must have a token in one place for it to stay.
CONSTANT = 0.5
#: Share of its occurrences that a template must stand apart from prose, and occurrences from which this is asked.
APART, ASKED = 0.5, 6

# The ways in which template languages and authors write an unfilled slot.
SLOT = "|".join(
    [
        r"\{\{\s*[\w. ]{1,40}\s*\}\}", r"\$\{\s*[\w.]{1,40}\s*\}", r"<%=?\s*[\w. ]{1,40}\s*%>", r"\{%\s*[\w. ]{1,40}\s*%\}", r"\[\[\s*[\w. ]{1,40}\s*\]\]",
        r"<<\s*[\w. ]{1,40}\s*>>", r"(?i:\[(?:insert|your|enter)\s[^\]\n]{1,40}\])", r"(?i:\((?:insert|enter|your)\s[\w. ]{1,40}\))", r"(?i:\[[\w. ]{1,40}\shere\])", r"@@[\w.]{1,40}@@",
        r"\b_{2,}[A-Za-z][\w.]{0,40}?__+", r"(?<![\w:]):[a-z]+_[a-z_]{1,40}\b", r"\bXX[A-Za-z_.]{2,40}?XX\b", r"\$[A-Za-z][A-Za-z_.]{1,40}\$", r"%[A-Za-z][A-Za-z_.]{2,40}%", r"<[a-z]+(?:_[a-z]+)*>", r"\{[A-Za-z][\w.]{1,40}\}", r"#\{[\w.]{1,40}\}", r"\{\d{1,2}\}", r"\bTK(?: TK)*\b",
        r"%[sd]\b", r"#(?:REF!|N/A|VALUE!|NAME\?|NULL!)", r"\[object Object\]",
    ]
)
# Words of error pages in four languages.
ERROR = r"""not found|introuvable|nicht gefunden|no se ha encontrado|no se encuentra|could not be found|internal server error|serverfehler|erreur interne|error interno|error code|(?:erreur|fehler|error) (?:http )?\d{3}|http (?:error )?\d{3}
bad gateway|gateway time-?out|service unavailable|no disponible|indisponible|nicht verfügbar|nicht mehr verfügbar|\d{3} forbidden|^forbidden|access denied|accès refusé|zugriff verweigert|acceso denegado|did not answer in time|antwortet nicht|ne répond pas|no responde
unexpected error|fehler aufgetreten|erreur est survenue|ocurrido un error|producido un error|no result was returned|is not reachable|could not be completed|file on the server is|has been removed or renamed|datensatz wurde gelöscht|enregistrement a été|registro ha sido|registro se ha
something went wrong|don't have permission|not allowed to (?:open|view)|error establishing|request failed|keine berechtigung|berechtigung|pas la permission|pas autorisé|no tiene permiso|algo salió mal|quelque chose s'est mal passé|etwas ist schiefgelaufen|anfrage konnte nicht|too many requests|session has (?:timed out|expired)|traceback \(most recent call|^keyerror\b|^\w+error:|^oops\b|^hoppla\b|^ups\b|^oups\b|we hit a snag|we can't find|adresse demandée|page you (?:were looking|asked) for|a traceback"""
# Words of notices that scripts are required.
SCRIPT = r"""javascript|^js (?:is|must|appears|wird|est|es|parece)\b|\bjs (?:is|must be|appears) |active content must|\bscripting\b|\bno-?script\b|active content is|aktive inhalte|client-side script|(?:enable|allow|activate|switch(?:ed)? on|turned off|blocked|required|need).{0,40}\bscripts?\b|\bscripts?\b.{0,60}(?:enable|allow|switched on|turned off|blocked|required|disabled|your settings)
skriptausführung|eingeschaltetem skript|skripte? (?:erlauben|aktivieren|zulassen)|exécution de scripts|ejecución de scripts|los scripts|les scripts"""
# Words of filler.
FILLER = r"""blindtext|fülltext|texte de remplissage|texto de relleno|texto simulado|faux texte|dummy (?:copy|text)|filler (?:copy|text)|placeholder (?:copy|text)|sample text|your text (?:goes )?here|(?:title|copy|subtitle|text|description|name) goes here|lorem ipsum
\bblah blah|\btest test test|^todo:|\btodo: |undefined by undefined|\bnan pages|invalid date|^(?:title|author|summary|publisher|isbn|genre|year): (?:null|undefined|nan|none)\b|\[object object|quick brown fox|asdf asdf|\bx{3,}(?: x{2,})+|type something here|enter (?:text|description) here"""
# The words of the customary mock Latin.
MOCK_LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum aenean"
# What follows an error or notice on its page, and the links around it.
AROUND = r"""again|retry|reload|go back|back to|previous page|contact the|help desk|sign in|administrator|browser settings|erneut|neu laden|réessayez|recharge|inténtelo|recarg|kennung|\bcode [0-9a-f]{6,}|startseite|accueil|catalogue|katalog|menu|my shelf|library portal|©|it may have been|cannot start without|preview\.\.\.|if nothing happens|n'existe plus|render_page|file \""""
# Words with which prose reports, quotes or explains such things.
REPORTS = r"""is called|\bwrites, and|\bjokes?\b|complains?|startled|made me laugh|handbook|\bmanual\b|le manuel|el manual|workbook|lehrbuch|handbuch|\bexercise\b|\bessay\b|\bnovel\b|\broman\b|\bpoet\b|\bpoem\b|ghost story|teaches|prints a traceback|volume and|mail merge|template variables|what a template|blank slots|second part|so many sites|walks through it|screen saying|line by line|running gag|history of|historia del|geschichte de|l'histoire d"""

# A bar of links, by its form; and calls to try again.
BAR = r"^[^|·»›.!?\n]{1,25}(?:\s[|·»›]\s[^|·»›.!?\n]{1,25}){2,}$"
RETRY = r"\btry (?:it )?(?:again|later)\b|\bretry\b|\breload\b|^(?:please )?go back\b|versuchen sie|erneut versuchen|\bneu laden\b|réessayez|rechargez|inténtelo|recargue"
#: Words of a call to try again and of a sentence of an error page without other signs, and sentences of its line, at most.
FEW_WORDS, SHORT_LINE, SENTENCES = 6, 20, 3

_one_line = lambda x: "(?i)(?:" + "|".join(x.strip().split("\n")) + ")"


def _mock(tokens: Column) -> Column:
    """Whether most of at least four words are mock Latin."""
    words = F.array_distinct(F.filter(tokens, lambda w: F.length(w) > 2))
    known = F.array(*[F.lit(w) for w in dict.fromkeys(MOCK_LATIN.split()) if len(w) > 2])
    return (F.size(words) >= 3) & (F.size(F.array_intersect(words, known)) >= 0.6 * F.size(words))


def messages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every sentence of ``docs``: (key, line, apart, kind, slots, masked, tokens).

    ``kind`` is the first that holds of slot, filler, error and script, 'error'
    for a short line without such signs that stands beside a bar of links or
    before a call to try again, and else null; ``apart`` says that no other
    sentence of the line is free of such signs.
    """
    lines = F.filter(F.split(F.col(text), r"\s*\n\s*"), lambda x: F.trim(x) != "")
    bar = lambda i: F.coalesce(F.get("lines", i).rlike(BAR), F.lit(False))
    lines = docs.select(F.col(key).alias("key"), lines.alias("lines"))
    lines = lines.select("key", F.posexplode(F.transform("lines", lambda x, i: F.struct(x.alias("words"), (bar(i - 1) | bar(i + 1)).alias("beside"), x.rlike(BAR).alias("bar")))).alias("line", "l")).select("key", "line", "l.*")
    part = F.transform(F.split("words", r"(?<=[.!?…])\s+"), lambda s: F.struct(s.alias("s"), F.lower(s).alias("low"), F.size(F.split(s, " ")).alias("n")))
    signs = F.transform(
        part,
        lambda p: F.struct(
            p["s"].alias("s"),
            F.when(p["s"].rlike(SLOT), "slot").when(p["low"].rlike(_one_line(FILLER)) | _mock(F.split(F.regexp_replace(p["low"], r"[^\p{L} ]", ""), r" +")), "filler").when(p["low"].rlike(_one_line(ERROR)), "error").when(p["low"].rlike(_one_line(SCRIPT)), "script").alias("kind"),
            p["low"].rlike(_one_line(AROUND)).alias("around"),
            (p["low"].rlike(RETRY) & (p["n"] <= FEW_WORDS)).alias("retry"),
            p["n"].alias("n"),
        ),
    )
    marked = stage(lines.select("key", "line", "beside", "bar", signs.alias("parts")), "sentences")
    apart = F.forall("parts", lambda p: p["kind"].isNotNull() | p["around"])
    page = ~F.col("bar") & (F.size("parts") <= SENTENCES) & F.forall("parts", lambda p: p["kind"].isNull() & (p["n"] <= SHORT_LINE)) & (F.col("beside") | F.exists("parts", lambda p: p["retry"]) & F.exists("parts", lambda p: ~p["retry"]))
    one = marked.select("key", "line", apart.alias("apart"), page.alias("page"), F.explode("parts").alias("p"))
    of_page = F.col("page") & ~F.col("p.retry")
    one = one.select("key", "line", (F.col("apart") | of_page).alias("apart"), "p.s", F.when(F.col("p.kind").isNull() & of_page, "error").otherwise(F.col("p.kind")).alias("kind"))
    masked = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace("s", SLOT, " ‹slot› "), r"\b[0-9a-fA-F]{8,}\b|\d+", "‹n›"), r"[\p{Punct}«»“”„—&&[^'%#$@]]+", " "))
    return one.select("key", "line", "apart", "kind", F.regexp_count("s", F.lit(SLOT)).alias("slots"), F.trim(F.regexp_replace(masked, r"\s+", " ")).alias("masked")).withColumn("tokens", F.split("masked", " "))


def mine(found: DataFrame) -> DataFrame:
    """(masked, leaf, template): the template of each distinct message of ``found`` (masked, tokens)."""
    every = found.select("masked", "tokens").distinct()
    n = F.size("tokens")
    leaf = F.concat_ws(" ", n.cast("string"), F.slice("tokens", 1, 2)[0], F.when(n > 1, F.col("tokens")[1]))
    every = every.withColumn("leaf", F.when(n <= LONG, leaf).otherwise(F.concat(F.lit("long "), F.col("tokens")[0])))
    places = every.filter(n <= LONG).select("leaf", F.posexplode("tokens").alias("pos", "token")).groupBy("leaf", "pos", "token").agg(F.count(F.lit(1)).alias("n"))
    tops = places.groupBy("leaf", "pos").agg(F.max_by("token", F.struct("n", "token")).alias("token"), F.max("n").alias("n"), F.sum("n").alias("all"))
    # an array of at most LONG tokens a leaf
    shape = tops.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("n") > F.col("all") * CONSTANT, F.col("token")).alias("token")))).alias("shape"))
    fit = F.zip_with("tokens", "shape", lambda t, c: F.when(c["token"] == t, t).otherwise("*"))
    return every.join(shape, "leaf", "left").select("masked", "leaf", F.when(F.col("shape").isNull(), F.col("leaf")).otherwise(F.concat_ws(" ", fit)).alias("template"))


def classify(found: DataFrame, templates: DataFrame) -> DataFrame:
    """(template, verdict, occurrences, apart_share): 'slot', 'filler', 'error', 'script' or 'mention' for each template."""
    # a message may also stand amid prose, where nothing made it one
    seen = found.groupBy("masked", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("apart") & F.col("kind").isNotNull()).cast("long")).alias("apart"))
    by = seen.join(templates, "masked").groupBy("template").agg(
        F.sum("n").alias("occurrences"), F.sum("apart").alias("apart"), F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("n"))).alias("kind"), F.max(F.col("masked").rlike(_one_line(REPORTS)).cast("int")).alias("reports")
    )
    share = F.col("apart") / F.col("occurrences")
    # slots stand amid prose by nature: there only the wording tells a mention
    least = F.when(F.col("kind").isin("error", "script"), APART).when(F.col("kind") == "filler", APART / 4).otherwise(0.0)
    mention = (F.col("reports") == 1) | (F.col("occurrences") >= ASKED) & (share < least)
    return by.select("template", F.when(mention, "mention").otherwise(F.col("kind")).alias("verdict"), "occurrences", share.alias("apart_share"))


def residue(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, verdicts): the keys of ``docs`` whose text holds residue, with the distinct kinds of it.

    The sentences are written once and read three times; verdicts are broadcast
    by nobody: templates may be many, and join by shuffle.
    """
    every = stage(messages(docs, key, text), "messages")
    found = every.filter("kind is not null")
    templates = stage(mine(found), "templates")
    verdicts = classify(every, templates)
    judged = templates.join(verdicts, "template").select("masked", "verdict").filter("verdict <> 'mention'")
    # a message read alone amid prose is judged by its template, unless it could be no more than a phrase of the prose
    alone = (F.col("verdict").isin("slot", "filler")) | F.col("apart")
    hits = found.join(judged, "masked").filter(alone)
    return hits.groupBy("key").agg(F.array_sort(F.collect_set("verdict")).alias("verdicts")).withColumnRenamed("key", key)
