"""Dictionaries, category tables, keyword lists, stop words.

Everything in this module is data that results depend on. The lists are small
(at most a few hundred entries) and of a size that never grows with the
responses, so operators may inline them into expressions.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Theme synonyms, canonical theme -> spellings that mean it.
# --------------------------------------------------------------------------
SYNONYM_GROUPS = {
    "pricing": (
        "prijs", "pricing", "te duur", "duur", "korting", "prijzen", "kosten",
        "abonnement", "subscription",
    ),
    "bezorging": (
        "levering", "delivery", "bezorging", "verzending", "shipping", "laat",
        "vertraging",
    ),
    "klantenservice": (
        "support", "klantenservice", "service", "helpdesk", "hulp", "assistentie",
    ),
    "stability": (
        "bug", "crash", "performance", "traag", "langzaam", "stabiliteit",
        "technisch",
    ),
    "app_ux": (
        "gebruiksvriendelijkheid", "usability", "ui", "design", "navigatie",
        "interface", "gebruik",
    ),
    "content_kwaliteit": (
        "content", "kwaliteit", "inhoud", "artikelen", "verhalen",
        "journalistiek", "nieuws", "actualiteit", "lokaal nieuws",
        "limited local news", "politieke bias", "political bias", "bias",
        "objectiviteit", "onpartijdigheid", "verslaggeving", "reportage",
        "artikel kwaliteit", "quality of articles", "kwaliteit artikelen",
        "redactie", "schrijven", "schrijfstijl", "diepgang", "onderzoek",
        "feiten", "waarheidsgetrouwheid",
    ),
    "merkvertrouwen": (
        "vertrouwen", "betrouwbaarheid", "reputatie", "geloofwaardigheid",
    ),
    "overige": ("overige", "anders", "misc"),
}

CATCH_ALL = "overige"
TAIL_CLUSTER = "Other (cluster)"

# Themes that are part of the base taxonomy, per report.
BASE_THEMES = ("content_kwaliteit", "pricing", "merkvertrouwen", "overige")
TITLE_BASE_THEMES = ("content_kwaliteit", "overige", "pricing", "delivery")
CLASSIFIER_LABELS = (
    "pricing", "bezorging", "content_kwaliteit", "klantenservice", "app_ux",
    "aboflexibiliteit", "merkvertrouwen", "overige",
)

# --------------------------------------------------------------------------
# Theme categories. Main: name, colour, sort order, description.
# --------------------------------------------------------------------------
MAIN_CATEGORIES = (
    ("Content", "#3B82F6", 1, "Content quality, writing, relevance, and editorial aspects"),
    ("Price", "#10B981", 2, "Pricing, billing, and cost-related feedback"),
    ("Delivery", "#F59E0B", 3, "Delivery process, timing, and packaging"),
    ("Customer Service", "#EF4444", 4, "Customer support and service quality"),
    ("User Experience", "#8B5CF6", 5, "Interface, navigation, and usability"),
    ("Other", "#6B7280", 6, "Uncategorized or miscellaneous feedback"),
)

# Sub: main, name, sort order, description.
SUB_CATEGORIES = (
    ("Content", "Writing Quality", 1, "General content writing and editorial quality"),
    ("Content", "Relevance/Timeliness", 2, "Content relevance and timeliness"),
    ("Content", "Readability", 3, "Content readability and clarity"),
    ("Content", "Objectivity/Bias", 4, "Content objectivity and bias concerns"),
    ("Content", "General Quality", 5, "General content quality issues"),
    ("Price", "Cost", 1, "General pricing and cost concerns"),
    ("Price", "Too Expensive", 2, "Feedback about high prices"),
    ("Price", "Billing Issues", 3, "Billing and invoicing problems"),
    ("Price", "Payment Process", 4, "Payment process and methods"),
    ("Delivery", "Timing", 1, "General delivery timing issues"),
    ("Delivery", "Delivery Speed", 2, "Slow or fast delivery feedback"),
    ("Delivery", "Delivery Process", 3, "Delivery process and logistics"),
    ("Delivery", "Packaging", 4, "Packaging quality and condition"),
    ("Customer Service", "Helpfulness", 1, "Customer service helpfulness"),
    ("Customer Service", "Service Quality", 2, "Overall service quality"),
    ("Customer Service", "Communication", 3, "Communication and contact quality"),
    ("Customer Service", "Response Time", 4, "Response time and speed"),
    ("User Experience", "Interface Design", 1, "Interface and design feedback"),
    ("User Experience", "Navigation", 2, "Navigation and user flow"),
    ("User Experience", "Usability", 3, "General usability concerns"),
    ("Other", "Uncategorized", 1, "Uncategorized feedback"),
)

# Static mapping: theme, main, sub, confidence, source, responses, mean score.
STATIC_THEME_MAPPING = (
    ("content_kwaliteit", "Content", "Writing Quality", "0.95", "pattern", 1000, "6.50"),
    ("overige", "Other", "Uncategorized", "0.95", "pattern", 1000, "5.80"),
    ("delivery", "Delivery", "Timing", "0.95", "pattern", 570, "6.20"),
    ("support", "Customer Service", "Helpfulness", "0.95", "pattern", 478, "6.80"),
    ("merkvertrouwen", "Content", "Objectivity/Bias", "0.95", "pattern", 1000, "7.10"),
    ("actualiteit", "Content", "Relevance/Timeliness", "0.95", "pattern", 6, "8.30"),
    ("facturering", "Price", "Billing Issues", "0.95", "pattern", 4, "3.00"),
    ("pricing", "Price", "Too Expensive", "0.95", "pattern", 352, "5.50"),
    ("leesbaarheid", "Content", "Readability", "0.95", "pattern", 3, "7.00"),
)

# --------------------------------------------------------------------------
# Theme name patterns in order of precedence, by main category:
# pattern -> sub category. The first matching pattern wins.
# --------------------------------------------------------------------------
THEME_PATTERN_BLOCKS = (
    ("Content", {
        "content_kwaliteit": "Content Kwaliteit", "actualiteit": "Actualiteit",
        "leesbaarheid": "Leesbaarheid", "merkvertrouwen": "Merkvertrouwen",
        "objectiviteit": "Objectiviteit", "kwaliteit": "Kwaliteit",
        "duurzaamheid": "Duurzaamheid", "betrouwbaarheid": "Betrouwbaarheid",
        "innovatie": "Innovatie", "communicatie": "Communicatie",
        "journalistiek": "Journalistiek", "inhoud": "Inhoud",
        "artikel": "Artikelen", "nieuws": "Nieuws", "redactie": "Redactie",
        "verhaal": "Verhalen", "tekst": "Tekst", "columnisten": "Columnisten",
        "columnist": "Columnisten", "column": "Columns",
        "interessante onderwerpen": "Interessante Onderwerpen",
        "onderwerpen": "Onderwerpen", "onderwerp": "Onderwerp",
        "interessant": "Interessante Content", "rubriek": "Rubrieken",
        "rubrieken": "Rubrieken", "thema": "Thema", "themas": "Thema's",
        "variatie": "Variatie", "analyses": "Analyses", "natuur": "Natuur",
        "interviews": "Interviews", "milieu": "Milieu",
        "gezondheid": "Gezondheid", "diversiteit": "Diversiteit",
        "taal": "Taal", "schrijffouten": "Schrijffouten",
        "taal- en schrijffouten": "Taal & Schrijffouten",
        "spelling": "Spelling", "grammatica": "Grammatica", "fout": "Fouten",
        "fouten": "Fouten", "relevantie": "Relevantie",
        "relevantie van inhoud": "Relevantie van Inhoud",
        "relevante": "Relevantie", "relevant": "Relevantie",
        "sensatiegerichtheid": "Sensatiegerichtheid", "sensatie": "Sensatie",
        "sensationalisme": "Sensationalisme", "dramatisch": "Dramatisch",
        "drama": "Drama",
    }),
    ("Price", {
        "pricing": "Prijzen", "prijs": "Prijs", "facturering": "Facturering",
        "betaling": "Betaling", "kosten": "Kosten", "waarde": "Waarde",
        "abonnement": "Abonnement", "tarief": "Tarief", "betalen": "Betalen",
    }),
    ("Delivery", {
        "delivery": "Bezorging", "bezorging": "Bezorging",
        "levertijd": "Levertijd", "verpakking": "Verpakking",
        "levering": "Levering", "snelheid": "Snelheid", "bezorg": "Bezorging",
        "post": "Post", "tijd": "Tijd",
    }),
    ("Customer Service", {
        "support": "Support", "klantenservice": "Klantenservice",
        "contact": "Contact", "reactietijd": "Reactietijd",
        "service": "Service", "hulp": "Hulp", "medewerker": "Medewerkers",
        "personeel": "Personeel", "medewerkers": "Medewerkers", "team": "Team",
        "klachtenafhandeling": "Klachtenafhandeling", "klacht": "Klachten",
        "klachten": "Klachten", "afhandeling": "Afhandeling",
        "behandeling": "Behandeling", "reactie": "Reactie",
        "respons": "Respons", "helpdesk": "Helpdesk",
        "assistentie": "Assistentie",
        "klantvriendelijkheid": "Klantvriendelijkheid",
        "klantendienst": "Klantendienst", "klant": "Klant",
        "klanten": "Klanten", "klantgericht": "Klantgericht",
        "klantgerichtheid": "Klantgerichtheid",
        "vriendelijk": "Vriendelijkheid", "vriendelijkheid": "Vriendelijkheid",
    }),
    ("User Experience", {
        "ux": "Gebruikerservaring", "interface": "Interface",
        "navigatie": "Navigatie",
        "gebruiksvriendelijkheid": "Gebruiksvriendelijkheid",
        "gebruiksvriendelijk": "Gebruiksvriendelijk",
        "makkelijk": "Gebruiksgemak", "moeilijk": "Moeilijkheid",
        "design": "Design", "app": "App Ervaring",
        "website": "Website Ervaring", "platform": "Platform Ervaring",
        "gebruikerservaring": "Gebruikerservaring",
        "toegankelijkheid": "Toegankelijkheid",
        "gebruiksgemak": "Gebruiksgemak", "gebruik": "Gebruik",
        "gebruiker": "Gebruiker", "gebruikers": "Gebruikers",
        "ervaring": "Ervaring", "interactie": "Interactie",
        "bediening": "Bediening", "functionaliteit": "Functionaliteit",
        "vormgeving": "Vormgeving", "lay-out": "Layout", "layout": "Layout",
        "opmaak": "Opmaak", "visueel": "Visueel", "visuele": "Visueel",
        "technisch": "Technical Issues", "probleem": "Problems",
        "storing": "Technical Issues", "uitval": "Downtime", "bug": "Bugs",
        "crash": "Crashes", "werkt": "Functionality",
        "werkt niet": "Not Working",
    }),
    ("Content", {
        "tevreden": "Tevredenheid", "blij": "Tevredenheid",
        "positief": "Positieve Feedback", "negatief": "Negatieve Feedback",
        "ontevreden": "Ontevredenheid", "goed": "Positieve Feedback",
        "slecht": "Negatieve Feedback", "overige": "Algemene Feedback",
    }),
)

# Keyword families tried after the patterns, in order:
# main category, sub category, keywords contained in the theme name.
THEME_KEYWORD_FAMILIES = (
    ("Content", "Quality", (
        "kwaliteit", "quality", "inhoud", "content", "onderwerp", "topic",
        "artikel", "column", "variatie", "analyse", "natuur", "interview",
        "milieu", "gezondheid", "diversiteit", "onderwijs",
    )),
    ("Price", "Cost", ("prijs", "price", "cost")),
    ("Delivery", "Delivery", ("bezorg", "deliver", "levering")),
    ("Customer Service", "Service", (
        "service", "support", "help", "klacht", "contact", "reactie", "klant",
        "customer", "vriendelijk",
    )),
    ("User Experience", "User Experience", (
        "design", "interface", "user", "gebruiker", "ervaring", "toegank",
        "gebruik", "interactie", "bediening", "vormgeving", "layout", "lay-out",
    )),
)

# --------------------------------------------------------------------------
# Comment keyword rules that re-label the catch-all theme, three
# rule sets, each an ordered list of (new theme, keywords).
# --------------------------------------------------------------------------
RECLASSIFY_DIRECT = (
    ("content_kwaliteit", (
        "nieuws", "artikel", "kwaliteit", "inhoud", "journalistiek", "bias",
        "objectiviteit", "verslaggeving", "lokaal", "regionaal", "politiek",
        "actualiteit",
    )),
    ("bezorging", (
        "bezorging", "levering", "laat", "vertraging", "delivery", "verzending",
    )),
    ("klantenservice", ("klantenservice", "support", "hulp", "service", "helpdesk")),
    ("pricing", ("prijs", "duur", "kosten", "abonnement", "pricing")),
)
RECLASSIFY_SIMPLE = (
    ("content_kwaliteit", (
        "nieuws", "artikel", "kwaliteit", "inhoud", "journalistiek", "bias",
        "objectiviteit", "verslaggeving", "lokaal", "regionaal", "politiek",
        "actualiteit", "krant", "magazine", "content", "redactie", "schrijven",
        "diepgang", "onderzoek", "feiten", "waarheidsgetrouwheid",
    )),
    ("bezorging", (
        "bezorging", "levering", "laat", "vertraging", "delivery", "verzending",
        "post", "bezorg",
    )),
    ("klantenservice", (
        "klantenservice", "support", "hulp", "service", "helpdesk",
        "klantendienst", "assistentie",
    )),
    ("pricing", (
        "prijs", "duur", "kosten", "abonnement", "pricing", "euro", "€",
    )),
    ("app_ux", (
        "website", "app", "online", "digitale", "gebruiksvriendelijk",
        "navigatie", "interface", "inloggen", "login",
    )),
)
RECLASSIFY_TARGETED = (
    ("content_kwaliteit", (
        "actuele informatie", "degelijke informatie", "goede informatie",
        "informatief", "betrouwbaar", "berichtgeving", "objectief", "duiding",
        "regio", "columnisten", "progressief", "voeten op de grond",
        "fijne informatie", "goed berichtgeving",
    )),
    ("tevredenheid", (
        "leest aangenaam", "leuk blad", "tevreden", "is goed", "prima blad",
        "heel tevreden", "goed", "leuk", "aangenaam",
    )),
    ("aanbeveling", (
        "beveel", "aanbevolen", "adviseer", "bepalen", "keuze", "zelf",
        "iedereen", "niemand",
    )),
    ("content_kwaliteit", (
        "weekendeditie", "inwoners", "regio", "lokaal", "regionaal",
    )),
    ("content_kwaliteit", (
        "puzzels", "tv programma", "helemaal", "weekend", "magazine",
    )),
)

# Summary words that turn a catch-all row into content quality.
CONTENT_SUMMARY_WORDS = (
    "taal", "schrijffout", "spelling", "grammatica", "fout", "relevantie",
    "relevant", "inhoud", "sensatie", "dramatisch", "drama", "kwaliteit",
    "artikel", "verhaal", "tekst", "nieuws", "redactie", "journalistiek",
)

# Business categories of theme names, first hit wins.
BUSINESS_CATEGORY_RULES = (
    ("Content", (
        "content", "kwaliteit", "journalistiek", "artikel", "nieuws", "verhaal",
        "column", "opinie", "verslag",
    )),
    ("Customer Service", (
        "service", "klant", "support", "klachten", "hulp", "contact",
    )),
    ("Delivery", (
        "delivery", "bezorging", "levering", "post", "aflevering", "bezorgen",
    )),
    ("Price", (
        "pricing", "prijs", "kosten", "abonnement", "tarief", "betaling",
    )),
    ("User Experience", (
        "ux", "gebruik", "interface", "app", "website", "navigatie",
        "toegankelijkheid", "gebruiksgemak", "vormgeving",
    )),
    ("Communication", (
        "communicatie", "email", "nieuwsbrief", "bericht", "notificatie",
    )),
    ("Brand & Trust", (
        "merk", "brand", "vertrouwen", "reputatie", "identiteit",
    )),
)
BUSINESS_CATEGORY_ORDER = (
    "Content", "Customer Service", "Delivery", "Communication", "Price",
    "User Experience", "Brand & Trust", "Other",
)

# Keywords by which a theme is counted in comments.
FREQUENCY_KEYWORDS = {
    "content_kwaliteit": ("artikel", "nieuws", "kwaliteit", "schrijven", "journalistiek"),
    "pricing": ("prijs", "kosten", "duur", "goedkoop", "abonnement"),
    "merkvertrouwen": ("vertrouwen", "geloofwaardig", "betrouwbaar", "reputatie"),
    "overige": ("andere", "overig", "divers"),
    "abonnement_beheer": ("abonnement", "opzeggen", "wijzigen", "betalen"),
    "mobiele_app": ("app", "mobiel", "telefoon", "smartphone"),
    "klantenservice": ("service", "klantenservice", "hulp", "ondersteuning"),
    "nieuws_actualiteit": ("actueel", "nieuws", "tijdig", "recent"),
}
HIGH_RELEVANCE_THEMES = (
    "abonnement_beheer", "klantenservice", "mobiele_app", "nieuws_actualiteit",
    "website_gebruik",
)
MEDIUM_RELEVANCE_THEMES = ("content_kwaliteit", "pricing", "delivery")

# Comment taxonomy, label -> keywords.
COMMENT_TAXONOMY = (
    ("Klantenservice", ("service", "support", "hulp", "klantenservice", "medewerker")),
    ("Productkwaliteit", ("kwaliteit", "product", "functionaliteit", "features", "prestaties")),
    ("Prijs/Value", ("prijs", "kosten", "waarde", "duur", "betaalbaar")),
    ("Gebruiksvriendelijkheid", ("gebruiksvriendelijk", "interface", "navigatie", "makkelijk", "moeilijk")),
    ("Betrouwbaarheid", ("betrouwbaar", "stabiel", "consistent", "fout", "bug")),
    ("Innovatie", ("nieuw", "innovatief", "modern", "verouderd", "achterhaald")),
    ("Communicatie", ("communicatie", "informatie", "transparantie", "duidelijkheid")),
    ("Levering", ("levering", "bezorging", "snelheid", "timing")),
    ("Technische problemen", ("technisch", "probleem", "storing", "uitval")),
    ("Algemene tevredenheid", ("tevreden", "blij", "positief", "negatief", "ontevreden")),
)

# --------------------------------------------------------------------------
# Stop words.
# --------------------------------------------------------------------------
DUTCH_STOP_WORDS = tuple(dict.fromkeys((
    "de", "het", "een", "en", "van", "is", "in", "op", "voor", "met", "te", "aan", "zijn", "dat", "die",
    "deze", "dit", "ook", "als", "maar", "bij", "om", "uit", "naar", "er", "door", "over", "hij", "ze", "hun",
    "wordt", "werd", "waren", "was", "hebben", "had", "heeft", "kan", "moet", "of", "dan", "nog", "wel",
    "niet", "geen", "meer", "veel", "andere", "sommige", "alle", "omdat", "ik", "je", "jij", "wij", "zij",
    "mijn", "jouw", "haar", "onze", "jullie", "zo", "zeer", "weer", "al", "dus", "toen", "nu", "hier", "daar",
    "waar", "hoe", "wat", "wie", "verleden",
)))
ENGLISH_STOP_WORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out",
    "day", "get", "has", "him", "his", "how", "its", "may", "new", "now", "old", "see", "two", "way", "who",
    "boy", "did", "man", "put", "say", "she", "too", "use",
)
HINT_STOP_WORDS = tuple(dict.fromkeys((
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out",
    "day", "get", "has", "him", "his", "how", "its", "may", "new", "now", "old", "see", "two", "way", "who",
    "boy", "did", "man", "oil", "sit", "try", "use", "why", "let", "put", "say", "she", "too", "een", "van",
    "de", "het", "is", "op", "te", "in", "aan", "met", "voor", "dat", "niet", "zijn", "als", "er", "maar",
    "dan", "ook", "nog", "over", "heeft", "hebben", "wordt", "worden", "kan", "kunnen", "moet", "moeten",
    "zal", "zullen", "zou", "zouden", "heb", "had", "hadden", "waren", "ben", "bent", "dit", "die", "deze",
    "zo", "wel", "geen", "alle", "alleen", "altijd", "al", "weer", "meer", "veel", "weinig", "groot", "klein",
    "goed", "slecht", "nieuw", "oud", "jong", "laat", "vroeg", "lang", "kort", "hoog", "laag", "breed",
    "smal", "dik", "dun", "warm", "koud", "hete", "koude", "nat", "droog", "schoon", "vuil", "mooi", "lelijk",
    "leuk", "saai", "interessant", "belangrijk", "nuttig", "handig", "makkelijk", "moeilijk", "duur",
    "goedkoop", "snel", "langzaam", "sterk", "zwak", "zwaar", "licht", "vol", "leeg", "open", "dicht",
    "binnen", "buiten", "boven", "onder", "links", "rechts", "achter", "naast", "tussen", "door", "rond",
    "om", "naar", "tot", "sinds", "tijdens", "na", "tijd", "uur", "dag", "week", "maand", "jaar", "morgen",
    "gisteren", "vandaag", "avond", "ochtend", "middag", "nacht",
)))


def synonym_pairs() -> list[tuple[str, str]]:
    """(synonym, canonical) rows of the default dictionary."""
    return [(s, c) for c, group in SYNONYM_GROUPS.items() for s in group]


def theme_patterns() -> list[tuple[str, str, str]]:
    """(pattern, main, sub) in order of precedence."""
    return [
        (pattern, main, sub)
        for main, block in THEME_PATTERN_BLOCKS
        for pattern, sub in block.items()
    ]
