"""Default lexicon and rules: vehicle-care market news in Thai and English."""

from __future__ import annotations

from briefloom.lexicons.model import Brand, Category, Competitor, Country, LabelRule, Lexicon, RuleSet, Signal, Term

# Context words, category weights and terms, brands, competitors, countries and markers.
CONTEXT_TH = ("รถยนต์", "รถ", "ยานยนต์", "ศูนย์บริการ", "อู่", "คาร์แคร์", "ยานพาหนะ", "อีวี", "ปิกอัพ", "กระบะ", "เก๋ง", "ค่ายรถ")
CONTEXT_EN = (
    "car", "cars", "vehicle", "vehicles", "automotive", "auto", "motor", "dealership", "workshop", "garage",
    "car care", "EV", "pickup truck", "fleet",
)

CATEGORY_WEIGHTS = (
    ("AUTO_MARKET", 6),
    ("EV", 6),
    ("AC_CLEANING", 14),
    ("INJECTOR", 12),
    ("TRADING", 9),
    ("OEM_BRANDS", 7),
)
# category, language, term, whether it is also a stored query
TERMS = (
    ("AUTO_MARKET", "th", "ยอดขายรถยนต์", True),
    ("AUTO_MARKET", "th", "ยอดจดทะเบียนรถยนต์", True),
    ("AUTO_MARKET", "th", "ยอดผลิตรถยนต์", True),
    ("AUTO_MARKET", "th", "ส่งออกรถยนต์", True),
    ("AUTO_MARKET", "th", "ตลาดรถยนต์มือสอง", True),
    ("AUTO_MARKET", "th", "อายุเฉลี่ยรถยนต์", False),
    ("AUTO_MARKET", "th", "รถเข้าศูนย์บริการ", True),
    ("AUTO_MARKET", "th", "ธุรกิจศูนย์บริการรถยนต์", False),
    ("AUTO_MARKET", "th", "ธุรกิจอู่ซ่อมรถ", True),
    ("AUTO_MARKET", "th", "ธุรกิจคาร์แคร์", True),
    ("AUTO_MARKET", "th", "ค่าซ่อมบำรุงรถยนต์", False),
    ("AUTO_MARKET", "th", "ค่าซ่อม", False),
    ("AUTO_MARKET", "th", "พฤติกรรมเจ้าของรถ", False),
    ("AUTO_MARKET", "th", "กำลังซื้อ", False),
    ("AUTO_MARKET", "th", "หนี้ครัวเรือน", False),
    ("AUTO_MARKET", "th", "ราคาน้ำมัน", False),
    ("AUTO_MARKET", "th", "สินเชื่อรถยนต์", True),
    ("AUTO_MARKET", "th", "สินเชื่อรถ", False),
    ("AUTO_MARKET", "th", "ยอดขายรถ", False),
    ("AUTO_MARKET", "th", "รถกระบะ", False),
    ("AUTO_MARKET", "th", "นโยบายอุตสาหกรรมยานยนต์", True),
    ("AUTO_MARKET", "th", "ภาษีนำเข้ารถยนต์", False),
    ("AUTO_MARKET", "th", "มาตรฐานสิ่งแวดล้อมรถยนต์", False),
    ("AUTO_MARKET", "th", "PM2.5", True),
    ("AUTO_MARKET", "th", "ฝุ่นละออง", False),
    ("AUTO_MARKET", "th", "คุณภาพอากาศ", True),
    ("AUTO_MARKET", "th", "อากาศในห้องโดยสาร", False),
    ("AUTO_MARKET", "en", "car sales Thailand", True),
    ("AUTO_MARKET", "en", "vehicle registrations Thailand", True),
    ("AUTO_MARKET", "en", "automotive production Thailand", True),
    ("AUTO_MARKET", "en", "automotive aftermarket", True),
    ("AUTO_MARKET", "en", "used car market", True),
    ("AUTO_MARKET", "en", "average vehicle age", False),
    ("AUTO_MARKET", "en", "service centre visits", False),
    ("AUTO_MARKET", "en", "vehicle maintenance cost", False),
    ("AUTO_MARKET", "en", "auto loan interest rate", False),
    ("AUTO_MARKET", "en", "emission regulation", False),
    ("AUTO_MARKET", "en", "emission rules", False),
    ("AUTO_MARKET", "en", "emission standard", False),
    ("AUTO_MARKET", "en", "environmental regulation", False),
    ("AUTO_MARKET", "en", "compliance cost", False),
    ("AUTO_MARKET", "en", "air quality index", False),
    ("AUTO_MARKET", "en", "workshop", False),
    ("AUTO_MARKET", "en", "garage", False),
    ("EV", "th", "ยอดขายรถ EV", True),
    ("EV", "th", "รถยนต์ไฟฟ้า", True),
    ("EV", "th", "ศูนย์บริการรถ EV", True),
    ("EV", "th", "บริการหลังการขาย EV", True),
    ("EV", "th", "ระบบปรับอากาศรถ EV", False),
    ("EV", "th", "ฮีทปั๊ม", False),
    ("EV", "th", "ระบายความร้อนแบตเตอรี่", False),
    ("EV", "th", "บำรุงรักษาแอร์รถไฟฟ้า", False),
    ("EV", "th", "เปิดตัวรถ EV รุ่นใหม่", True),
    ("EV", "th", "นโยบายสนับสนุน EV", True),
    ("EV", "en", "EV sales Thailand", True),
    ("EV", "en", "EV service network", True),
    ("EV", "en", "EV after-sales problem", True),
    ("EV", "en", "EV heat pump HVAC", True),
    ("EV", "en", "battery thermal management", False),
    ("EV", "en", "EV cabin air quality", True),
    ("EV", "en", "EV incentive policy", False),
    ("AC_CLEANING", "th", "แอร์รถยนต์", True),
    ("AC_CLEANING", "th", "ล้างแอร์", True),
    ("AC_CLEANING", "th", "ตู้แอร์", False),
    ("AC_CLEANING", "th", "คอยล์เย็น", False),
    ("AC_CLEANING", "th", "คอยล์ร้อน", False),
    ("AC_CLEANING", "th", "อีวาโปเรเตอร์", False),
    ("AC_CLEANING", "th", "ไส้กรองอากาศ", False),
    ("AC_CLEANING", "th", "ล้างแอร์รถยนต์", True),
    ("AC_CLEANING", "th", "ล้างแอร์ไม่ถอดตู้", True),
    ("AC_CLEANING", "th", "ล้างคอยล์เย็นรถยนต์", True),
    ("AC_CLEANING", "th", "กลิ่นอับในรถ", True),
    ("AC_CLEANING", "th", "เชื้อรา", True),
    ("AC_CLEANING", "th", "แบคทีเรีย", False),
    ("AC_CLEANING", "th", "ฆ่าเชื้อในรถยนต์", False),
    ("AC_CLEANING", "en", "car air conditioning cleaning", True),
    ("AC_CLEANING", "en", "automotive evaporator cleaning", True),
    ("AC_CLEANING", "en", "automotive condenser cleaning", True),
    ("AC_CLEANING", "en", "non-disassembly AC cleaning", True),
    ("AC_CLEANING", "en", "cabin air cleaning", True),
    ("AC_CLEANING", "en", "car air deodorizing", False),
    ("AC_CLEANING", "en", "car air disinfection", False),
    ("AC_CLEANING", "en", "automotive HVAC maintenance", True),
    ("AC_CLEANING", "en", "cabin air quality", True),
    ("AC_CLEANING", "en", "automotive mold and bacteria", False),
    ("AC_CLEANING", "en", "car odor removal", True),
    ("AC_CLEANING", "en", "air conditioning maintenance equipment", False),
    ("INJECTOR", "th", "ล้างหัวฉีด", True),
    ("INJECTOR", "th", "ล้างลิ้นปีกผีเสื้อ", False),
    ("INJECTOR", "th", "เขม่าคาร์บอนเครื่องยนต์", False),
    ("INJECTOR", "th", "ประหยัดน้ำมันเชื้อเพลิง", False),
    ("INJECTOR", "th", "มาตรฐานไอเสียรถยนต์", True),
    ("INJECTOR", "th", "ตรวจวัดแรงม้า", False),
    ("INJECTOR", "en", "fuel injector cleaning", True),
    ("INJECTOR", "en", "fuel injector cleaning machine", True),
    ("INJECTOR", "en", "fuel system cleaning", True),
    ("INJECTOR", "en", "carbon cleaning engine", True),
    ("INJECTOR", "en", "engine performance service", False),
    ("INJECTOR", "en", "fuel economy service", False),
    ("INJECTOR", "en", "emission reduction service", False),
    ("INJECTOR", "en", "throttle body cleaning", False),
    ("INJECTOR", "en", "fuel additive", False),
    ("INJECTOR", "en", "injector cleaner", True),
    ("TRADING", "th", "น้ำยาล้างห้องเครื่อง", True),
    ("TRADING", "th", "ไล่หนูในรถยนต์", True),
    ("TRADING", "th", "หนูกัดสายไฟรถ", True),
    ("TRADING", "th", "น้ำยาล้างจานเบรก", False),
    ("TRADING", "th", "เคลือบเบาะรถยนต์", True),
    ("TRADING", "th", "เคลือบยางรถยนต์", False),
    ("TRADING", "th", "ผลิตภัณฑ์ดูแลรถยนต์", True),
    ("TRADING", "en", "engine bay cleaning", True),
    ("TRADING", "en", "engine bay coating", False),
    ("TRADING", "en", "rat repellent for car", True),
    ("TRADING", "en", "rodent damage in vehicles", True),
    ("TRADING", "en", "brake cleaner", False),
    ("TRADING", "en", "brake disc cleaner", False),
    ("TRADING", "en", "car seat coating", False),
    ("TRADING", "en", "interior coating car", False),
    ("TRADING", "en", "tire coating", False),
    ("TRADING", "en", "car detailing chemicals", True),
    ("TRADING", "en", "car care products", True),
    ("TRADING", "en", "automotive chemical", False),
    ("TRADING", "en", "automotive chemicals", False),
    ("TRADING", "en", "cleaning product", False),
    ("TRADING", "en", "cleaning products", False),
    ("OEM_BRANDS", "th", "เปิดศูนย์บริการใหม่", True),
    ("OEM_BRANDS", "th", "ปิดศูนย์บริการ", True),
    ("OEM_BRANDS", "th", "เปลี่ยนผู้แทนจำหน่าย", False),
    ("OEM_BRANDS", "th", "เรียกคืนรถ", True),
    ("OEM_BRANDS", "th", "ปัญหาระบบแอร์รถยนต์", True),
    ("OEM_BRANDS", "th", "ขยายเครือข่ายศูนย์บริการ", True),
    ("OEM_BRANDS", "th", "บริการดูแลรถใหม่", False),
    ("OEM_BRANDS", "en", "new service centre opening", True),
    ("OEM_BRANDS", "en", "dealer network expansion", True),
    ("OEM_BRANDS", "en", "vehicle recall air conditioning", True),
    ("OEM_BRANDS", "en", "warranty change", False),
    ("OEM_BRANDS", "en", "service interval change", False),
    ("OEM_BRANDS", "en", "car care service launch", False),
)
PRIORITY_BRANDS = ("Toyota", "Isuzu")
BRAND_TABLE = (
    ("Toyota", ("โตโยต้า",)),
    ("Isuzu", ("อีซูซุ",)),
    ("Honda", ("ฮอนด้า",)),
    ("Mitsubishi", ("มิตซูบิชิ", "มิตซู")),
    ("BYD", ("บีวายดี",)),
    ("Tesla", ("เทสลา",)),
    ("Ford", ("ฟอร์ด",)),
    ("Mercedes-Benz", ("เมอร์เซเดส", "เบนซ์")),
    ("BMW", ("บีเอ็มดับเบิลยู",)),
    ("Nissan", ("นิสสัน",)),
    ("Mazda", ("มาสด้า",)),
    ("Suzuki", ("ซูซูกิ",)),
    ("MG", ("เอ็มจี",)),
    ("GWM", ("เกรท วอลล์", "เกรทวอลล์")),
    ("Changan", ("ฉางอาน",)),
    ("NETA", ("เนต้า",)),
    ("Geely", ("จีลี่",)),
    ("Zeekr", ("ซีเคอร์",)),
    ("Hyundai", ("ฮุนได",)),
    ("Kia", ("เกีย",)),
)
COMPETITOR_TABLE = (
    ("Wizard", ("Wizard", "วิซาร์ด", "วิซาร์ท"), True),
    ("Air Klean", ("Air Klean", "AirKlean", "แอร์คลีน", "แอร์ คลีน"), True),
    ("ECO AIR", ("ECO AIR", "EcoAir", "อีโคแอร์", "อีโค แอร์", "ECO MACHINE"), True),
    ("Fresh Car", ("Fresh Car", "FreshCar", "เฟรชคาร์", "เฟรช คาร์"), False),
    ("Fresh Air", ("Fresh Air", "เฟรชแอร์", "เฟรช แอร์"), True),
    ("WISE", ("WISE", "ไวส์", "Wise Lubricant", "ริชไวส์"), True),
)
NEGATIVE_CONTEXT = (
    "money transfer", "remittance", "fintech", "โอนเงิน", "แลกเงิน", "harry potter", "wizard of oz", "เกม", "game",
    "anime", "การ์ตูน", "air purifier for home", "เครื่องฟอกอากาศในบ้าน",
)
HOME = Country("TH", ("Thailand", "ไทย"))
MARKETS = (
    Country("SG", ("Singapore", "สิงคโปร์")),
    Country("PH", ("Philippines", "ฟิลิปปินส์")),
    Country("LA", ("Laos", "ลาว")),
    Country("TW", ("Taiwan", "ไต้หวัน")),
    Country("VN", ("Vietnam", "เวียดนาม")),
    Country("QA", ("Qatar", "กาตาร์")),
    Country("HK", ("Hong Kong", "ฮ่องกง")),
    Country("KR", ("South Korea", "เกาหลีใต้")),
    Country("OM", ("Oman", "โอมาน")),
)
PRESS_RELEASE_MARKERS = (
    "ข่าวประชาสัมพันธ์", "PR News", "press release", "newswire", "prnewswire", "businesswire", "แถลงข่าว",
)
SPONSORED_MARKERS = ("advertorial", "sponsored", "paid partnership", "โฆษณา", "บทความโฆษณา")
HARD_EXCLUDE = ("ดูดวง", "หวย", "เลขเด็ด", "ผลบอล", "horoscope", "lottery")
COMPETITOR_QUALIFIERS = (
    ("th", ("ล้างแอร์รถยนต์", "คาร์แคร์", "ศูนย์บริการรถยนต์")),
    ("en", ("car air cleaning", "automotive air cleaning", "car care")),
)
BRAND_TEMPLATES = (("th", "{brand} ศูนย์บริการ"), ("en", "{brand} service network"))


VEHICLE_CARE_LEXICON = Lexicon(
    context_terms=CONTEXT_TH + CONTEXT_EN,
    categories=tuple(Category(cid, w, tuple(Term(t, lang, query) for c, lang, t, query in TERMS if c == cid)) for cid, w in CATEGORY_WEIGHTS),
    brands=tuple(Brand(name, aliases, name in PRIORITY_BRANDS) for name, aliases in BRAND_TABLE),
    competitors=tuple(Competitor(name, aliases, ambiguous) for name, aliases, ambiguous in COMPETITOR_TABLE),
    negative_context=NEGATIVE_CONTEXT,
    guard_all_competitors=True,
    home=HOME,
    markets=MARKETS,
    hard_exclude=HARD_EXCLUDE,
    press_release_markers=PRESS_RELEASE_MARKERS,
    sponsored_markers=SPONSORED_MARKERS,
    competitor_qualifiers=COMPETITOR_QUALIFIERS,
    brand_templates=BRAND_TEMPLATES,
)

# Impact patterns. \b is spelled out as an ASCII edge, so EV is found inside Thai text.
EV_PATTERN = "(^|[^A-Za-z0-9_])EV([^A-Za-z0-9_]|$)|รถยนต์ไฟฟ้า|electric vehicle|battery electric|BEV|ปลั๊กอิน|plug-?in"
DISTRESS_PATTERN = "ปัญหา|ร้องเรียน|ถอน|ยกเลิก|recall|complaint|lawsuit"
# pattern, weight, label; ``{org}`` stands for the organisation's name
POSITIVE_RULES = (
    ("เปิดศูนย์|ศูนย์บริการใหม่|new service (centre|center)|ขยายเครือข่าย|expansion", 2, "More service sites: the workshop customers of {org} grow in number"),
    ("ยอดขายรถ.*เพิ่ม|เติบโต|โต\\s*\\d|growth|increase|rise|surge|up \\d+%", 2, "Car market up: more vehicles come in for service"),
    ("PM ?2\\.?5|ฝุ่น|คุณภาพอากาศ|air quality|cabin air|มลพิษ", 2, "Air quality in the news: interest in cabin cleaning rises"),
    ("เชื้อรา|กลิ่นอับ|แบคทีเรีย|mold|bacteria|odor", 3, "Smell or mould in cars: a case for the main service of {org}"),
    ("ล้างแอร์|evaporator clean|hvac clean|cabin air clean", 3, "About the main service itself"),
    ("อายุเฉลี่ยรถ|รถเก่า|aging vehicle|average vehicle age", 2, "Ageing cars: upkeep is in demand"),
)
NEGATIVE_RULES = (
    ("ยอดขาย.*ลด|หดตัว|ชะลอ|decline|drop|fall|slump|down \\d+%", 2, "Market down: fewer vehicles come in"),
    ("ปิดศูนย์|เลิกกิจการ|ปิดโรงงาน|close|shut down|layoff|ปลดพนักงาน", 2, "Closures: customers are lost"),
    ("สงครามราคา|ลดราคา|ตัดราคา|price war|discount war", 3, "Prices under pressure: thinner margins"),
    ("ต้นทุน.*เพิ่ม|ค่าเงิน|ภาษี.*เพิ่ม|cost increase|tariff|inflation", 2, "Costs up: lower profit"),
    ("หนี้ครัวเรือน|ปฏิเสธสินเชื่อ|reject.*loan|credit tighten", 2, "Buyers short of money"),
)
CHANNEL_PATTERNS = (
    ("OEM", "OEM|โตโยต้า|toyota|isuzu|อีซูซุ|ค่ายรถ|ผู้ผลิตรถ"),
    ("B2B", "ศูนย์บริการ|อู่|คาร์แคร์|workshop|garage|dealer|service cent"),
    ("B2C", "เจ้าของรถ|ผู้บริโภค|consumer|car owner|ลูกค้าทั่วไป"),
)
PRODUCT_PATTERNS = (
    "ล้างแอร์|แอร์รถ|evaporator|condenser|hvac|cabin air|กลิ่น|เชื้อรา|air condition",
    "หัวฉีด|injector|สันดาป|combustion|น้ำมันเชื้อเพลิง|fuel system|carbon clean",
    "น้ำยา|เคลือบ|coating|detailing|brake clean|car care|ห้องเครื่อง|หนู",
)
CATEGORY_PRIORITY = ("AC_CLEANING", "INJECTOR", "TRADING", "OEM_BRANDS", "AUTO_MARKET", "INTERNATIONAL")


def vehicle_care_rules(
    org: str = "us",
    products: tuple[str, str, str] = ("AC_CLEANING", "FUEL_CLEANING", "TRADING"),
    fuel_product_name: str = "injector cleaning",
) -> RuleSet:
    """Impact rules for an organisation; its name and product ids appear in labels and results."""
    return RuleSet(
        positive=tuple(Signal(pattern, weight, label.format(org=org)) for pattern, weight, label in POSITIVE_RULES),
        negative=tuple(Signal(pattern, weight, label.format(org=org)) for pattern, weight, label in NEGATIVE_RULES),
        dual_pattern=EV_PATTERN,
        dual_positive_label="Electric cars have cabins to clean too",
        dual_negative_label=f"Electric cars need no {fuel_product_name}",
        dual_reason=f"electric cars: good for {products[0]}, bad for {products[1]}, both counted",
        dual_category="EV",
        distress_pattern=DISTRESS_PATTERN,
        distress_label=f"A rival in difficulty leaves room for {org}",
        rival_label="Rivals on the move: {names}",
        rival_reason="rivals named: {names}",
        damped_reason="weak or unverified source, weights reduced",
        no_reason="judged by rules alone",
        interpretation="Judged by rules, no model took part; read the source before acting on it.",
        default_action="Read the source and estimate the effect",
        default_owner="Business Intelligence",
        channels=tuple(LabelRule(cid, p) for cid, p in CHANNEL_PATTERNS),
        brand_channel="OEM",
        products=tuple(LabelRule(pid, p) for pid, p in zip(products, PRODUCT_PATTERNS)),
        category_priority=CATEGORY_PRIORITY,
    )


VEHICLE_CARE_RULES = vehicle_care_rules()
