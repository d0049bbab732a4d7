"""Word lists, lookup tables, constants and patterns that decide results.

They are kept together, as plain text and in natural order, because changing any one of them changes what the
jobs return. Everything else in the package reads them from here.
"""

# Currency rates to the rouble.
CURRENCY_RATES = {"RUB": 1.0, "USD": 90.0, "EUR": 100.0, "KZT": 0.17, "UAH": 2.5}

# A numeric price above these limits is already in minor units.
ONLINE_MINOR_LIMIT = 10000
RECOGNITION_MINOR_LIMIT = 9999

# Token spelling -> canonical brand.
BRANDS = {
    "бабкины": "babkiny", "бабкин": "babkiny", "яшкино": "yashkino", "милка": "milka", "milka": "milka",
    "нескафе": "nescafe", "nescafe": "nescafe", "джинн": "djinn", "gin": "djinn", "мартин": "martin",
    "мартина": "martin", "нивеа": "nivea", "nivea": "nivea", "ариэль": "ariel", "ariel": "ariel",
    "палмолив": "palmolive", "palmolive": "palmolive", "дав": "dove", "dove": "dove", "колгейт": "colgate",
    "colgate": "colgate", "персил": "persil", "persil": "persil", "splat": "splat", "сплат": "splat",
    "president": "president", "президент": "president",
}

# Inflected or variant token -> base token.
TOKEN_ALIASES = {
    "семечки": "семечка", "семечек": "семечка", "семена": "семечка", "вафли": "вафля", "вафельные": "вафля",
    "трубочки": "трубочка", "полосатые": "полосатый", "полосатых": "полосатый", "классические": "классический",
    "жареные": "жареный", "жаренные": "жареный", "соленые": "соленый", "солью": "соль", "морская": "морской",
    "очищенные": "очищенный", "тыквы": "тыква", "тыквенные": "тыква", "шампуни": "шампунь", "шампуня": "шампунь",
    "гели": "гель", "крема": "крем", "кремы": "крем", "порошки": "порошок", "капсулы": "капсула",
    "таблетки": "таблетка", "пасты": "паста", "паста": "паста", "зубная": "зубной", "зубные": "зубной",
    "бальзамы": "бальзам", "средства": "средство", "посуда": "посуды", "бутылки": "бутылка",
    "бутылка": "бутылка", "флаконы": "флакон",
}

# Words that carry no product meaning.
STOP_WORDS = ["и", "в", "на", "для", "с", "со", "без", "из", "от", "руб", "цена", "шт"]

# Product families, in lookup order.
FAMILIES = [
    "семечка", "вафля", "трубочка", "кофе", "чай", "шоколад", "печенье", "конфета", "соус", "лапша", "мыло",
    "гель", "шампунь", "крем", "порошок", "капсула", "таблетка", "паста", "ополаскиватель", "дезодорант",
    "бальзам", "средство",
]

# Weak words, variant words and packaging words.
WEAK_WORDS = ["классический", "жареный", "соленый", "соль", "морской"]
VARIANT_WORDS = [
    "полосатый", "тыква", "очищенный", "лимон", "яблоко", "алоэ", "кокос", "лаванда", "свежесть", "мята",
    "ромашка", "жасмин", "color", "колор", "автомат", "sensitive", "сенситив",
]
PACKAGING_WORDS = ["пакет", "флакон", "бутылка", "туба", "коробка", "дойпак", "саше"]

# Inflection endings removed from Cyrillic tokens longer than four letters.
STEM_ENDINGS = (
    "ыми|ими|ого|его|ому|ему|ая|яя|ое|ее|ые|ие|ый|ий|ой|ей|ов|ев|ам|ям|ах|ях|а|я|ы|и|е|у|ю"
)

# One-way transliteration (the letter ё is left alone).
RU_TO_LAT_ONE_WAY = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e",
    "ю": "yu", "я": "ya",
}

# Letters of the two halves of the transliteration fold used for matching.
LAT_TO_RU_FOLD = {
    "a": "а", "b": "б", "v": "в", "g": "г", "d": "д", "e": "е", "zh": "ж", "z": "з", "i": "и", "y": "й",
    "k": "к", "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "r": "р", "s": "с", "t": "т", "u": "у",
    "f": "ф", "ch": "ч",
}
RU_TO_LAT_FOLD = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i",
    "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t",
    "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ы": "y", "э": "e",
    "ю": "yu", "я": "ya",
}

# Match scoring, in ten-thousandths (token weights in hundredths).
WEIGHT_WEAK, WEIGHT_PLAIN, WEIGHT_STRONG = 35, 100, 120
POINTS_TOKENS = 7000
POINTS_SUBSTRING = 1500
POINTS_TRANSLIT = 4000
POINTS_BRAND = 1600
POINTS_FAMILY = 1200
POINTS_SIZE_EQUAL, POINTS_SIZE_MISMATCH, POINTS_SIZE_MISSING = 1800, -800, -200
POINTS_PER_VARIANT, POINTS_VARIANT_MAX = 400, 800
POINTS_OTHER_VARIANT = -500
POINTS_PACKAGING, PACKAGING_CAP = -800, 8900
PARTIAL_TOKENS, PARTIAL_SIGNALS, PARTIAL_CAP = 2, 2, 6500
SCORE_CAP = 9900
AMBIGUOUS_SIZE_SCORE = 0.45
DEFAULT_CANDIDATES = 30

# Decision thresholds (photo flow, evidence flow, bulk accept).
AUTO_SCORE, AUTO_MARGIN = 0.90, 0.08
SUGGEST_SCORE, SUGGEST_FAMILY_SCORE = 0.66, 0.52
EVIDENCE_SELECT, EVIDENCE_REVIEW, EVIDENCE_MARGIN = 0.82, 0.70, 0.04
BULK_ACCEPT_SCORE = 0.90
ALIAS_SCORE = 0.99
EXTERNAL_CONFIDENCE_CAP = 0.89
EXTERNAL_CONFIDENCE_DEFAULT = 0.65

# Report thresholds and labels.
LARGE_DIFF = 0.05
LOW_CONFIDENCE = 0.7
LOW_COVERAGE_PCT = 50
LOW_OCR_CONFIDENCE = 0.75
EXPORT_STATUSES = ["matched", "confirmed", "unmatched", "needs_review"]
DEPARTMENT_LABELS = {"products": "Продукты", "chemistry": "Химия"}
NO_DEPARTMENT_LABEL = "Без отдела"
COMMENT_NOT_FOUND = "Подтверждено: не продаём / нет в ассортименте"
COMMENT_NO_PRODUCT = "Нет уверенного совпадения с каталогом, проверить вручную"
COMMENT_NO_OWN_PRICE = "Есть кандидат из каталога, но нет нашей цены"
COMMENT_REVIEW = "Нужно проверить вручную"
COMMENT_CHEAPER = "Конкурент дешевле нашей цены на 5%+"
COMMENT_DEARER = "Конкурент дороже нашей цены на 5%+"
OWN_PRICE_LABEL = "наша цена"

# Review badges.
BADGE_NO_CANDIDATE = "Без кандидата"
BADGE_SIZE_RISK = "Риск размера"
BADGE_NO_OWN_PRICE = "Нет нашей цены"
BADGE_NO_OCR_SIZE = "Нет размера OCR"
BADGE_CHECK_OCR = "Проверь OCR"
BADGE_AI_REVIEW = "Кандидат требует проверки"
BADGE_NOT_SOLD = "Нет в ассортименте"

# Retailer name patterns, in priority order.
SOURCE_PATTERNS = {
    "spar_online": ["спар", "spar"],
    "metro_online": ["метро", "metro"],
    "magnit": ["магнит", "magnit"],
    "x5_5ka": ["пятёрочка", "пятерочка", "5ка", "5ka", "x5"],
}

# Base address per page source, used for relative links.
SOURCE_BASE_URL = {
    "spar_online": "https://spar-online.ru",
    "metro_online": "https://online.metro-cc.ru",
    "magnit": "https://magnit.ru",
    "x5_5ka": "https://5ka.ru",
}

# Model prices, US dollars per million tokens (input, output).
MODEL_PRICES = {"gpt-5.4-nano": (0.2, 1.25), "gpt-5.4-mini": (0.75, 4.5)}

# Header spellings of catalogue files.
CATALOG_HEADERS = {
    "external_sku": ["external_sku", "sku", "артикул"],
    "name": ["name", "название", "наименование"],
    "brand": ["brand", "бренд"],
    "size_text": ["size_text", "size", "размер"],
    "price": ["price", "price_rub", "цена", "цена_руб"],
}
ERROR_NO_SKU = "external_sku обязателен"
ERROR_NO_NAME = "name обязателен"
SHEET_DEPARTMENTS = {"Химия": "chemistry", "Продукты": "products"}

# Labels that mark a price in shelf text.
OLD_PRICE_LABELS = ["старая", "стар.", "стар", "было", "обычная", "обычн.", "обычн", "зачерк", "перечерк"]
PROMO_PRICE_LABELS = ["новая", "нов.", "нов", "акция", "акц", "скидка", "скид", "спец", "sale", "promo", "промо"]
MIN_RUB, MAX_RUB = 1, 999_999

# Domains of the enumerated columns.
DOMAINS = {
    "availability": ["in_stock", "out_of_stock", "unknown"],
    "source_key": ["spar_online", "metro_online", "magnit", "x5_5ka"],
    "legal_status": ["pending", "allowed", "blocked"],
    "price_context": ["online_delivery", "store_visit", "catalog_promo"],
    "run_trigger": ["cron", "manual", "retry"],
    "session_status": ["draft", "uploading", "processing", "review", "completed", "failed", "cancelled"],
    "photo_status": ["uploaded", "queued", "processing", "processed", "failed", "expired"],
    "item_status": ["recognized", "matched", "needs_review", "unmatched", "confirmed", "rejected"],
    "job_status": ["queued", "running", "succeeded", "failed", "cancelled"],
    "match_method": ["barcode", "fuzzy", "llm", "manual"],
    "match_status": ["auto", "needs_review", "confirmed", "rejected"],
    "run_status": ["queued", "running", "succeeded", "failed", "cancelled"],
    "alert_type": ["competitor_cheaper", "price_change", "out_of_stock", "run_failure"],
    "alert_status": ["new", "ack", "resolved"],
    "severity": ["info", "warning", "critical"],
    "week": [1, 2],
}
