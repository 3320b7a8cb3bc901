"""Rule tables and limits.

Every job takes these as parameters; the module-level values are the defaults
that reproduce the original application's behaviour.  Keyword tables are
matched as lower-case substrings, first match in declaration order wins.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the original application's values for identical
# results).  Kept verbatim and in their original order.
# ---------------------------------------------------------------------------

# Two-tier commission table of store "Magalu": keyword -> (1P rate, 3P rate).
COMMISSION_TWO_TIER = [
    ("games", 6.0, 3.5),
    ("game", 6.0, 3.5),
    ("console", 4.5, 2.5),
    ("ps5", 4.5, 2.5),
    ("xbox", 4.5, 2.5),
    ("nintendo", 4.5, 2.5),
    ("informática", 4.0, 2.5),
    ("informatica", 4.0, 2.5),
    ("hardware", 4.5, 2.5),
    ("computador", 3.5, 2.0),
    ("notebook", 3.5, 2.0),
    ("monitor", 4.0, 2.5),
    ("periféricos", 6.5, 3.5),
    ("perifericos", 6.5, 3.5),
    ("mouse", 6.5, 3.5),
    ("teclado", 6.5, 3.5),
    ("headset", 6.5, 3.5),
    ("acessórios", 7.0, 4.0),
    ("acessorios", 7.0, 4.0),
    ("casa inteligente", 5.0, 3.0),
    ("áudio", 5.5, 3.5),
    ("audio", 5.5, 3.5),
    ("fone", 6.0, 3.5),
    ("caixa de som", 5.5, 3.5),
    ("smart house", 5.0, 3.0),
    ("eletrônicos", 3.5, 2.0),
    ("eletronicos", 3.5, 2.0),
    ("celulares", 2.5, 1.5),
    ("smartphones", 2.5, 1.5),
    ("telefonia", 2.5, 1.5),
    ("tv", 3.0, 2.0),
    ("eletroportáteis", 5.0, 3.0),
    ("eletrodomésticos", 3.5, 2.0),
]
COMMISSION_TWO_TIER_DEFAULT = (4.0, 2.5)
FIRST_PARTY_SELLERS = ["magazineluiza", "magalu", "magazine luiza"]
DEFAULT_SELLER = "magazineluiza"

# One-tier commission table of store "Mercado Livre": keyword -> rate.
COMMISSION_ONE_TIER = [
    ("games", 6.5),
    ("game", 6.5),
    ("console", 5.0),
    ("ps5", 5.0),
    ("xbox", 5.0),
    ("nintendo", 5.0),
    ("jogos", 7.0),
    ("informática", 5.0),
    ("informatica", 5.0),
    ("hardware", 4.5),
    ("computador", 4.0),
    ("notebook", 4.0),
    ("mouse", 6.5),
    ("teclado", 6.5),
    ("headset", 6.5),
    ("periféricos", 6.5),
    ("perifericos", 6.5),
    ("ssd", 5.0),
    ("monitor", 4.5),
    ("celulares", 3.5),
    ("celular", 3.5),
    ("smartphone", 3.5),
    ("telefonia", 3.5),
    ("áudio", 7.0),
    ("audio", 7.0),
    ("fone", 7.0),
    ("caixa de som", 6.5),
    ("casa inteligente", 6.0),
    ("smart house", 6.0),
    ("eletrônicos", 5.0),
    ("eletronicos", 5.0),
]
COMMISSION_ONE_TIER_DEFAULT = 5.0

# Banned product-name terms per store.
BANNED_TERMS_STORE_A = ["cabo", "pelicula", "capinha", "adaptador", "suporte",
                        "conector", "carregador", "capa para"]

# Niche bonus terms.
OFF_NICHE_TERMS = [
    "fechadura", "cadeado", "vitrola", "camera wi-fi", "câmera wi-fi",
    "lampada", "lâmpada", "tomada", "interruptor", "geladeira",
    "fritadeira", "panela", "aspirador", "cafeteira", "ventilador", "chaleira",
    "lixeira", "dispenser", "saboneteira", "baba", "babá", "banheiro", "cozinha",
    "fralda", "detergente", "sabao", "sabão", "shampoo", "creme dental",
    "camiseta", "tenis", "tênis", "colchao", "colchão", "travesseiro",
    "whey", "creatina", "suplemento", "perfume",
]
STRONG_NICHE_TERMS = [
    "ps5", "ps4", "playstation", "xbox", "nintendo", "switch", "gamer",
    "headset", "controle", "joystick", "dualsense", "ssd", "nvme",
    "mouse", "teclado", "mecanico", "mecânico", "monitor", "rtx", "gtx",
    "placa de video", "placa de vídeo", "console", "jogo", "gta", "fifa",
    "ea fc", "call of duty", "dark souls", "halo", "red dead", "hyperx",
    "logitech", "razer", "corsair", "redragon", "fifine", "havit",
    "jbl", "fone", "bluetooth", "tws", "notebook", "gabinete", "ram",
]
CATEGORY_NICHE_TERMS = ["game", "informática", "informatica", "áudio", "audio", "tech"]
NICHE_SCORES = (-150.0, 180.0, 90.0, 0.0)  # off-niche, strong, category, none

# Strong-niche terms of the admission predicate (second store).
ADMISSION_STRONG_TERMS = [
    "iphone", "galaxy", "samsung", "motorola", "xiaomi", "poco", "redmi",
    "smartphone", "celular", "smart tv", "tablet", "ipad", "kindle",
    "ssd", "nvme", "ryzen", "intel", "rtx", "gtx", "geforce", "radeon",
    "monitor", "mouse", "teclado", "headset", "fone", "tws", "caixa de som",
    "soundbar", "jbl", "playstation", "ps5", "ps4", "xbox", "nintendo", "switch",
    "controle", "dualsense", "notebook", "gamer", "roteador", "smartwatch",
    "webcam", "microfone", "cadeira gamer", "placa mae", "placa-mãe", "memória ram",
]

# Block / bot-wall indicator terms, searched in lower(body) in this order.
BLOCK_INDICATORS = [
    "captcha", "recaptcha", "hcaptcha", "cloudflare", "cf-chl", "access denied",
    "request blocked", "bot detection", "verify you are human",
    "verificação de segurança", "account-verification", "suspicious traffic",
    "akamai", "incapsula", "datadome",
]
BLOCK_STATUS_CODES = [403, 406, 429, 503]

# Portuguese stop list of the topic-similarity test.
TOPIC_STOPWORDS = [
    "a", "o", "as", "os", "um", "uma", "uns", "umas", "de", "do", "da", "dos", "das",
    "em", "no", "na", "nos", "nas", "por", "para", "pro", "pra", "com", "sem", "sob",
    "sobre", "entre", "ate", "apos", "e", "ou", "mas", "que", "se", "como", "mais",
    "menos", "ja", "nao", "sim", "novo", "nova", "novos", "novas", "seu", "sua",
    "seus", "suas", "ao", "aos", "pelo", "pela", "via", "tem", "sao", "vai",
]

# Editorial category tag: keyword groups searched in upper(tag), first group wins;
# otherwise the first 16 characters of the tag, or TECH when blank.
CATEGORY_TAG_GROUPS = [
    ("HARDWARE", ["HARD", "GPU", "CPU", "PC", "SSD"]),
    ("GAMES", ["GAME", "JOGO", "CONSOLE", "PS5", "XBOX", "SWITCH"]),
    ("TECH", ["TECH", "CEL", "MOBILE", "AI", "IA"]),
]

# Editorial footer prefix and highlight token pattern.
SOURCE_FOOTER_PREFIX = "📰 Fonte: "
HIGHLIGHT_TOKEN_PATTERN = "[a-z0-9à-ÿ]+"

# Store names and SKU prefixes.
STORE_A = "Magalu"
STORE_B = "Mercado Livre"
STORE_UNKNOWN = "Desconhecida"
SKU_PREFIX_A = "MAGALU_"
SKU_PREFIX_B = "ML_"

# Image upscaling replacements (first store).
IMAGE_SIZE_REPLACEMENTS = [("{w}x{h}", "800x600"), ("/186x140/", "/800x600/"),
                           ("/280x210/", "/800x600/")]

# Affiliate tracking parameters (second store); neutral values, a deployment passes its own.
AFFILIATE_PARAMS = [("matt_tool", "10000000"), ("matt_word", "partner")]
AFFILIATE_HOST = "https://www.mercadolivre.com.br"

# Channel score weights: channel -> (minimum bonus, drop weight, niche bonus?).
CHANNEL_WEIGHTS = [
    ("x", 100.0, 2.0, False),
    ("threads", 100.0, 2.0, False),
    ("telegram", 150.0, 3.0, True),
    ("facebook_feed", 200.0, 3.5, True),
    ("vertical", 100.0, 2.0, True),
]
CHANNEL_LIMITS = {"telegram": 10, "facebook_feed": 3, "x": 2, "threads": 5, "vertical": 2}

# Limits and windows.
HISTORY_DAYS = 180
WARMUP_DAYS = 5
DROP_ALERT_PCT = 5.0
IMPLAUSIBLE_DISCOUNT_PCT = 85.0
REPEAT_LOCK_HOURS = 72
MIN_FRESH_OFFERS = 25
TOTAL_PICKS = 20
TARGET_B = 15
TARGET_A = 5
CANDIDATE_CAP_B = 80
CANDIDATE_CAP_B_ALONE = 120
CANDIDATE_CAP_TOTAL = 120
CANDIDATE_FLOOR_A = 40
NEWS_WINDOW_HOURS = 24
NEWS_FUTURE_MINUTES = 15
TOPIC_DEDUP_DAYS = 7
TOPIC_TOKENS = 16
TOPIC_JACCARD = 0.55
TOPIC_CONTAINMENT = 0.60
TOPIC_MIN_SHARED = 3
NEWS_CANDIDATES = 30
SUMMARY_MAX_CHARS = 280
RETENTION_PRICE_DAYS = 180
RETENTION_POSTED_DAYS = 30
RETENTION_TOPIC_DAYS = 90
MAX_ROW_LOSS = 0.15
TELEMETRY_KEEP = 500
X_COST_PER_POST = 0.015
USD_BRL = 5.80
LOCAL_UTC_OFFSET_HOURS = -3
LOCAL_ZONE = "America/Sao_Paulo"
REQUIRED_TABLES = ["historico_precos", "historico_postados", "pautas_rss", "metadados_sync"]

# ---------------------------------------------------------------------------
# Test rule tables used by the registered queries on the driver tables, whose
# product names are colour/size + noun ("red widget", "small ring", ...).
# ---------------------------------------------------------------------------
TEST_COMMISSION_TWO_TIER = [
    ("widget", 6.0, 3.5),
    ("gizmo", 5.5, 3.5),
    ("gear", 4.5, 2.5),
    ("ring", 4.0, 2.5),
    ("plate", 3.5, 2.0),
    ("promo", 7.0, 4.0),
]
TEST_COMMISSION_ONE_TIER = [
    ("widget", 6.5),
    ("anvil", 7.0),
    ("bolt", 5.0),
    ("rod", 4.5),
    ("economy", 3.5),
]
TEST_BANNED_TERMS = ["cold anvil"]
TEST_OFF_NICHE_TERMS = ["old", "rod"]
TEST_STRONG_NICHE_TERMS = ["widget", "gizmo", "gear"]
TEST_CATEGORY_NICHE_TERMS = ["promo", "standard"]

# ---------------------------------------------------------------------------
# FIXED VALUES of the response and text jobs.
# ---------------------------------------------------------------------------
URL_PATTERN = r"https?://\S+|www\.\S+"
TELEGRAM_LINK_PATTERN = r"\bt\.me/\S+"
DOMAIN_ENDINGS = "com|net|org|br|io|gg|tv|co|me|ly|app|tech"
DEFAULT_NEWS_SOURCE = "Redação Tech"
HEADLINE_VIA = " — Via "
TOP_UP_REASON = "Seleção automática pelo ranking Alpha-Profit (fallback determinístico)."
PURGE_VALID_HOURS = 6
