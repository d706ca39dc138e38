"""Fixed values of the message-risk domain.

Every value in this module is a fixed value: word lists, label tables, reply
texts, templates and patterns that have to be exactly these for results to be
right.  They are listed in their natural order and hold no logic.  All of them
are defaults of function parameters and can be replaced by the caller.
"""

# --- fixed values: labels and risk levels ------------------------------------
LABELS = ["ham", "spam", "phishing"]
LABELS_TH = ["ข้อความปกติ", "สแปม", "ฟิชชิ่ง (หลอกลวง)"]
RISK_LEVELS = ["low", "high", "high"]
RISK_LEVELS_TH = ["ต่ำ", "สูง", "สูงมาก"]

# --- fixed values: numeric signals, in feature order -------------------------
SIGNALS = [
    "text_length",
    "word_count",
    "url_count",
    "phone_count",
    "exclamation_count",
    "number_ratio",
    "caps_ratio",
]

# --- fixed values: explanation texts -----------------------------------------
REASON_URL = "พบลิงก์ URL"
REASON_PHONE = "พบเบอร์โทรศัพท์"
REASON_EXCLAMATION = "มีเครื่องหมายอัศเจรีย์มากผิดปกติ"
EXPLAIN_BLANK = "ข้อความว่างเปล่า"
EXPLAIN_HAM = "ข้อความนี้ดูเป็นปกติ ไม่พบสัญญาณอันตราย"
EXPLAIN_SPAM_PREFIX = "พบคำเสี่ยง: "
EXPLAIN_SPAM_DEFAULT = "รูปแบบข้อความคล้ายกับสแปมที่พบบ่อย"
EXPLAIN_PHISHING_PREFIX = "พบคำที่ใช้หลอกลวง: "
EXPLAIN_PHISHING_DEFAULT = "รูปแบบข้อความคล้ายกับการหลอกลวงทางออนไลน์"

# --- fixed values: reply texts per label (header takes the percentage) --------
REPLY_TEXTS = {
    "spam": {
        "header": "อุ๊ย! ข้อความนี้เป็นสแปมเลยค่ะ ระวังด้วยนะ (มั่นใจ {pct}%)",
        "keywords": "คำที่น่าสงสัย: ",
        "advice": [
            "แนะนำอย่าตอบกลับหรือกดลิงก์อะไรนะคะ ลบทิ้งเลยดีกว่าค่ะ",
            "ถ้าสงสัยเพิ่มเติม โทร 1599 สายด่วนไซเบอร์ได้เลย ฟรี 24 ชม. ค่ะ",
        ],
    },
    "phishing": {
        "header": "โอ้โห อันตรายมากเลยค่ะ! ข้อความนี้คือฟิชชิ่ง พยายามหลอกขโมยข้อมูลชัดเจนเลย (มั่นใจ {pct}%)",
        "keywords": "สัญญาณอันตราย: ",
        "advice": [
            "ห้ามคลิกลิงก์ ห้ามให้ OTP หรือรหัสผ่านกับใครนะคะ อันตรายมากจริงๆ ค่ะ",
            "โทร 1599 สายด่วนไซเบอร์ด่วนเลยค่ะ ฟรี 24 ชม.",
        ],
    },
    "other": {
        "header": "ผลวิเคราะห์: {label_th} | ความเสี่ยง: {risk} ({pct}%)",
        "keywords": "คำเตือน: ",
        "advice": [],
    },
}
REPLY_NOT_READY = "ขออภัยนะคะ ตอนนี้ระบบยังไม่พร้อม ลองส่งมาใหม่อีกทีได้เลยค่ะ"
REPLY_FAILED = "ขออภัยนะคะ เกิดข้อผิดพลาดในการวิเคราะห์ข้อความ ลองใหม่อีกครั้งได้เลยค่ะ"
FEEDBACK_THANKS = "ขอบคุณสำหรับข้อเสนอแนะ เราจะนำไปปรับปรุงระบบ"

# --- fixed values: question routing, first keyword contained wins ------------
FAQ_KEYWORDS = [
    ("สแปม", "สแปมคืออะไร"),
    ("spam", "สแปมคืออะไร"),
    ("ฟิชชิ่ง", "ฟิชชิ่งคืออะไร"),
    ("phishing", "ฟิชชิ่งคืออะไร"),
    ("ถูกหลอก", "ถูกหลอกแล้วทำอย่างไร"),
    ("โดนโกง", "ถูกหลอกแล้วทำอย่างไร"),
    ("โอนเงิน", "ถูกหลอกแล้วทำอย่างไร"),
    ("สังเกต", "วิธีสังเกตข้อความอันตราย"),
    ("อันตราย", "วิธีสังเกตข้อความอันตราย"),
    ("รู้ได้อย่างไร", "วิธีสังเกตข้อความอันตราย"),
    ("otp", "otp คืออะไร"),
    ("รหัส", "otp คืออะไร"),
    ("สายด่วน", "สายด่วน"),
    ("โทร", "สายด่วน"),
    ("1599", "สายด่วน"),
    ("แจ้งความ", "ถูกหลอกแล้วทำอย่างไร"),
]
CHAT_FALLBACK = (
    "ตอนนี้เชื่อมต่อระบบ AI ไม่ได้ ขออภัยด้วย\n\n"
    "หากต้องการความช่วยเหลือด่วน โทรสายด่วน 1599 ได้ตลอด 24 ชั่วโมง\n\n"
    "หรือลองถามใหม่อีกครั้งภายหลัง"
)

# --- fixed values: prefixes and suffixes added as noise -----------------------
NOISE_PREFIXES = ["", "📢 ", "⚠️ ", "🔔 ", "‼️ ", ""]
NOISE_SUFFIXES = ["", " ค่ะ", " ครับ", " นะ", " นะคะ", " นะครับ", " จ้า", ""]

# --- fixed values: texts that a CSV reader of the corpora takes as missing ----
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: keyword lists, replacements, template fillers, templates ---
SPAM_KEYWORDS = [
    "รางวัล",
    "ยินดีด้วย",
    "ฟรี",
    "ด่วน",
    "กด",
    "ลิงก์",
    "โปรโมชั่น",
    "ลดราคา",
    "เงินสด",
    "กู้เงิน",
    "ดอกเบี้ยต่ำ",
    "อนุมัติทันที",
]

PHISHING_KEYWORDS = [
    "otp",
    "รหัส",
    "ยืนยัน",
    "บัญชี",
    "ธนาคาร",
    "บัตร",
    "ระงับ",
    "แจ้งเตือน",
    "ตำรวจ",
    "ศาล",
    "หมายเรียก",
    "กรมสรรพากร",
]

KEYWORD_REPLACEMENTS = {
    "free": "ฟรี",
    "won": "ชนะ",
    "winner": "ผู้ชนะ",
    "prize": "รางวัล",
    "claim": "รับรางวัล",
    "cash": "เงินสด",
    "urgent": "ด่วน",
    "call now": "โทรเดี๋ยวนี้",
    "limited": "จำนวนจำกัด",
    "selected": "ได้รับการเลือก",
    "congratulations": "ยินดีด้วย",
    "click": "กด",
    "link": "ลิงก์",
}

PRIZES = [
    5000,
    10000,
    20000,
    50000,
    100000,
    500000,
    1000000,
]

DISCOUNTS = [
    30,
    50,
    70,
    80,
    90,
]

PROFITS = [
    20,
    30,
    50,
    100,
    200,
]

BANKS = [
    "กสิกรไทย",
    "กรุงไทย",
    "ไทยพาณิชย์",
    "กรุงเทพ",
    "ทหารไทยธนชาต",
]

LOCATIONS = [
    "เชียงใหม่",
    "ภูเก็ต",
    "สุราษฎร์ธานี",
    "ต่างประเทศ",
    "ออนไลน์",
]

PLACES = [
    "ญี่ปุ่น",
    "เกาหลี",
    "ยุโรป",
    "ออสเตรเลีย",
    "สิงคโปร์",
]

TIMES = [
    "08:00",
    "09:00",
    "10:00",
    "13:00",
    "14:00",
    "15:00",
    "16:00",
]

FAKE_URLS = [
    "bit.ly/reward-th",
    "tinyurl.com/claim-now",
    "gg.gg/thai-prize",
    "thai-bank-verify.net/login",
    "krungsri-secure.cc/confirm",
    "scb-auth.xyz/verify",
    "line-verify.net/account",
    "tmb-secure.info/otp",
]

LEGIT_URLS = [
    "forms.gle/xXec3Zjw76FdeNkKA",
    "forms.gle/abc123def456",
    "docs.google.com/forms/d/e/example",
    "language.kmitl.ac.th",
    "reg.kmutt.ac.th/register",
    "training.chula.ac.th/course",
    "cpe.ku.ac.th/event",
    "human.mfu.ac.th/training",
    "shortcourse.nida.ac.th",
    "elearning.mhesi.go.th",
    "personnel.moph.go.th/training",
    "skillplus.dsd.go.th",
]

UNIVERSITIES = [
    "สจล.",
    "จุฬาฯ",
    "ธรรมศาสตร์",
    "มหิดล",
    "เกษตรศาสตร์",
    "บูรพา",
    "นเรศวร",
    "KMUTT",
    "NIDA",
    "KMITL",
]

COURSE_NAMES = [
    "TOEIC Fast Track",
    "Excel ขั้นสูง",
    "Python สำหรับนักธุรกิจ",
    "การบริหารโครงการ PMP",
    "ภาษาอังกฤษเพื่อธุรกิจ",
    "Data Analytics",
    "AI สำหรับผู้เริ่มต้น",
    "การเงินส่วนบุคคล",
]

COURSE_PRICES = [
    499,
    699,
    799,
    999,
    1200,
    1500,
    1800,
    2000,
    2500,
    3000,
]

REAL_PHONES = [
    "02-329-8000",
    "02-470-8000",
    "02-218-0000",
    "02-564-4440",
    "053-916-100",
]

FAKE_PHONES = [
    "062-345-6789",
    "081-234-5678",
    "095-678-9012",
    "02-123-4567",
    "1234",
    "1800-xxx-xxx",
]

FAKE_OTPS = [
    "123456",
    "987654",
    "456789",
    "234567",
    "876543",
]

HAM_TEMPLATES = [
    "สวัสดีครับ วันนี้อากาศดีมากเลยนะครับ",
    "แม่คะ วันนี้หนูจะกลับบ้านช้าหน่อย รอหน่อยนะคะ",
    "พรุ่งนี้นัดหมอที่โรงพยาบาล เวลา {time} นะครับ อย่าลืม",
    "คุณแม่ครับ ยาที่หมอสั่งกินหลังอาหารทุกมื้อนะครับ",
    "สวัสดีปีใหม่ครับ ขอให้มีสุขภาพแข็งแรง อายุยืนนะครับ",
    "คุณพ่อครับ วันอาทิตย์ครอบครัวจะไปทานข้าวด้วยกัน",
    "ร้านขายยาใกล้บ้านปิดปรับปรุงชั่วคราว กลับมาเปิดวันจันทร์",
    "นัดออกกำลังกายตอนเช้า เวลา {time} ที่สวนสาธารณะนะครับ",
    "ลูกฝากบอกว่าจะโทรมาคุยตอนเย็น รอรับสายด้วยนะครับ",
    "ขอบคุณที่ดูแลหลานนะครับ เดี๋ยวจะไปรับตอน {time}",
    "วันนี้อาหารกลางวันทำอะไรดีครับ หิวแล้ว",
    "อย่าลืมกินยาความดันนะครับ ทุกเช้า",
    "โทรหาหน่อยนะครับ มีเรื่องจะคุย",
    "ไฟฟ้าจะดับในหมู่บ้านพรุ่งนี้ช่วง {time} ถึง {time2}",
    "สมัครสมาชิกห้องสมุดได้แล้ว ฟรีทุกกิจกรรม",
    "วันนี้ฝนตก ระวังลื่นนะครับ",
    "ขอให้หายป่วยเร็วๆ นะครับ",
    "เพื่อนบ้านฝากบอกว่า พรุ่งนี้จะเอาผักมาให้",
    "วัดจะมีงานทำบุญวันที่ {date} นะครับ",
    "ไม่ต้องห่วงนะครับ ทุกอย่างเป็นปกติดี",
    "ครอบครัวส่งความระลึกถึงมาด้วยนะครับ",
    "หลานฝากบอกว่ารักคุณตายายมากนะครับ",
    "ร้านอาหารใกล้บ้านเปิดใหม่ รสชาติดีมาก",
    "ช่วยซื้อของจากตลาดมาให้หน่อยได้ไหมครับ",
    "วันเกิดลูกสาวแล้ว อย่าลืมโทรไปอวยพรนะ",
    "แจ้งเตือนจากธนาคาร{bank} กรุณาติดต่อได้ที่ธนาคาร{bank}ทุกสาขา",
    "ธนาคาร{bank} แจ้งว่าสาขาใกล้บ้านท่านเปิดให้บริการ จันทร์–ศุกร์ {time}–{time2} น.",
    "ธนาคาร{bank}: บัตร ATM ของท่านหมดอายุในเดือนหน้า กรุณาติดต่อสาขาเพื่อต่ออายุบัตร",
    "ธนาคาร{bank} ขอแจ้งว่าระบบจะปิดปรับปรุงชั่วคราว คืนนี้ {time}–{time2} น.",
    "แจ้งเตือน: บัญชีออมทรัพย์ธนาคาร{bank} ของท่านได้รับดอกเบี้ยประจำเดือนแล้ว",
    "ธนาคาร{bank} ขอแจ้งอัตราดอกเบี้ยเงินฝากใหม่ มีผลตั้งแต่วันที่ {date} สอบถามได้ที่สาขา",
    "ธนาคาร{bank}: ท่านสามารถตรวจสอบยอดบัญชีผ่านแอปพลิเคชันธนาคารได้ตลอด 24 ชั่วโมง",
    "แจ้งจากธนาคาร{bank}: สาขา {location} เปิดให้บริการตามปกติแล้ว",
    "ธนาคาร{bank} ขอขอบคุณที่ใช้บริการ หากมีข้อสงสัยติดต่อได้ที่สาขาหรือ Call Center",
    "ธนาคาร{bank}: โปรดตรวจสอบรายการเคลื่อนไหวบัญชีผ่านแอปหรือตู้ ATM ของธนาคาร",
    "การไฟฟ้าฯ แจ้งว่าจะดำเนินการตัดต้นไม้ใกล้สายไฟในหมู่บ้าน วันที่ {date}",
    "ประกันสังคมแจ้ง: ท่านสามารถตรวจสอบสิทธิ์ได้ที่สำนักงานประกันสังคมทุกจังหวัด",
    "กรมสรรพากรแจ้ง: กำหนดการยื่นภาษีเงินได้บุคคลธรรมดาปีนี้ สิ้นสุดวันที่ {date}",
    "โรงพยาบาล{location} แจ้งนัดผู้ป่วยประจำ วันที่ {date} เวลา {time} น. กรุณามาตามนัด",
    "เทศบาลแจ้ง: งดจ่ายน้ำประปาชั่วคราว วันที่ {date} เวลา {time}–{time2} น. เพื่อซ่อมท่อ",
    "สำนักงานเขตแจ้ง: โครงการฉีดวัคซีนผู้สูงอายุฟรี วันที่ {date} ที่ศูนย์บริการสาธารณสุข",
    "อบต.แจ้ง: การประชุมประชาคมหมู่บ้านวันที่ {date} เวลา {time} น. ณ ศาลาประชาคม",
    "AIS แจ้ง: แพ็กเกจโทรศัพท์ของท่านจะหมดอายุวันที่ {date} กรุณาต่ออายุที่ศูนย์บริการ AIS",
    "True Move H แจ้ง: ท่านใช้อินเทอร์เน็ตครบโควต้าแล้ว ความเร็วจะลดลงจนกว่าจะถึงรอบบิลใหม่",
    "DTAC แจ้ง: ยอดค่าโทรเดือนนี้ของท่านคือ {course_price} บาท กำหนดชำระภายในวันที่ {date}",
    "ศูนย์ภาษา {university} เปิดรับสมัครคอร์ส {course_name} รุ่นที่ {batch} วันที่ {date}–{date2} ค่าลงทะเบียน {course_price} บาท สมัคร: {legit_url}",
    "คณะวิศวกรรมศาสตร์ {university} ขอเชิญเข้าร่วมสัมมนา {course_name} วันที่ {date} ไม่เสียค่าใช้จ่าย ลงทะเบียน: {legit_url}",
    "มหาวิทยาลัย{university} ประกาศรับสมัครอบรม {course_name} ประจำปี {year} รับจำนวนจำกัด {seats} ที่นั่ง สมัคร: {legit_url}",
    "โครงการอบรมวิชาชีพ {course_name} เรียนออนไลน์ผ่าน MS Teams วันที่ {date} เวลา 09.00–16.00 น. ค่าลงทะเบียน {course_price} บาท",
    "ประกาศจากฝ่ายทรัพยากรบุคคล: เปิดรับสมัครอบรม {course_name} ประจำปี {year} นักศึกษา/บุคลากร ค่าลงทะเบียน {course_price} บาท รายละเอียด: {legit_url}",
    "สมาคมวิชาชีพ{university} ขอเชิญเข้าร่วมประชุมวิชาการ วันที่ {date} ณ อาคาร{location} ค่าลงทะเบียน {course_price} บาท สมัคร: {legit_url}",
    "แจ้งตารางสอบ {course_name} ประจำปี {year} สำหรับนักศึกษา ตรวจสอบตารางและสมัครสอบได้ที่ {legit_url}",
    "กองทุนการศึกษา แจ้ง: เปิดรับสมัครทุน{course_name} ประจำปี {year} กรอกใบสมัครออนไลน์ที่ {legit_url} ก่อนวันที่ {date}",
    "ศูนย์บริการวิชาการ {university} เปิดคอร์ส {course_name} Fast Track รุ่นใหม่ เน้นทำข้อสอบจริง {course_price} บาท โทรสอบถาม: {phone_real}",
    "ประกาศ {university}: การอบรม {course_name} สำหรับนักศึกษาและศิษย์เก่า ราคาพิเศษ {course_price} บาท บุคคลทั่วไป {course_price2} บาท สมัครได้ถึงวันที่ {date}: {legit_url}",
    "ร้าน{location} ฉลองครบรอบ {years} ปี ลด {discount}% ทุกเมนู วันที่ {date}–{date2} จองโต๊ะล่วงหน้า: {legit_url}",
    "คลินิก{location} แจ้ง: โปรแพ็กเกจตรวจสุขภาพประจำปี ราคา {course_price} บาท นัดหมายออนไลน์: {legit_url}",
    "โรงแรม{location} โปรโมชั่นพักผ่อนช่วงหยุดยาว ราคาเริ่มต้น {course_price} บาท/คืน จองได้ที่ {legit_url}",
    "ประกันสุขภาพ{university} โปรพิเศษสำหรับผู้สูงอายุ เบี้ยประกันเริ่ม {course_price} บาท/ปี ข้อมูลเพิ่มเติม: {legit_url}",
]

SPAM_TEMPLATES = [
    "ยินดีด้วย! คุณได้รับรางวัลใหญ่ {prize} บาท กดลิงก์เพื่อรับรางวัล: {url}",
    "🎉 โปรโมชั่นพิเศษ! ลดราคา {discount}% ทุกสินค้า วันนี้วันเดียว กด: {url}",
    "คุณถูกเลือกรับเงิน {prize} บาทจากโครงการพิเศษ โทร {phone} ด่วน!",
    "สมัครสินเชื่อด่วน อนุมัติทันที ไม่ต้องมีหลักทรัพย์ โทร {phone}",
    "รับฟรี! ของขวัญมูลค่า {prize} บาท เพียงกรอกข้อมูล: {url}",
    "แจ้งเตือน: บัญชีของคุณมีปัญหา กดที่นี่เพื่อแก้ไข: {url} ด่วน!",
    "เงินกู้ด่วน อนุมัติภายใน {time} นาที ดอกเบี้ยต่ำ โทร {phone}",
    "ลงทุนกับเราวันนี้ กำไร {profit}% ต่อเดือน ไม่มีความเสี่ยง: {url}",
    "ขอแสดงความยินดี! คุณชนะการจับฉลาก รางวัล {prize} บาท ยืนยัน: {url}",
    "โปรแกรมพิเศษสำหรับผู้สูงอายุ รับเงิน {prize} บาทต่อเดือน โทร {phone}",
    "Flash Sale! {discount}% OFF เฉพาะ {time} ชั่วโมง สั่งได้ที่: {url}",
    "คุณมีสิทธิ์รับประกันสังคมพิเศษ {prize} บาท ลงทะเบียน: {url}",
    "ร้านใหม่เปิด! ซื้อ 1 แถม 1 ทุกเมนู วันนี้เท่านั้น กด: {url}",
    "ชนะรางวัล iPhone ใหม่ล่าสุด! รีบยืนยันก่อนหมดเวลา: {url}",
    "โปรพิเศษ! เติมเงิน {prize} บาท ได้รับ {bonus} บาท โทร {phone}",
    "ด่วน! บัตรของคุณถูกระงับ ติดต่อเราที่ {phone} หรือ {url}",
    "ฟรี! ทริปท่องเที่ยว {place} {nights} คืน เพียงกรอกแบบสอบถาม: {url}",
    "สมัครวันนี้รับ {prize} บาททันที โปรนี้มีจำนวนจำกัด: {url}",
]

PHISHING_TEMPLATES = [
    "แจ้งเตือนจาก {bank}: บัญชีของท่านพบรายการผิดปกติ กรุณายืนยัน OTP: {otp} ภายใน {time} นาที",
    "ธนาคาร{bank}แจ้ง: รหัส OTP ของท่านคือ {otp} ห้ามบอกใครเด็ดขาด รวมถึงพนักงานธนาคาร",
    "เจ้าหน้าที่ธนาคาร: บัตรของท่านจะถูกระงับ กรุณาโทรยืนยัน {phone} ด่วน",
    "LINE แจ้งเตือน: มีคนพยายามเข้าสู่ระบบบัญชีของคุณ กรุณายืนยัน: {url}",
    "กสทช.แจ้ง: เบอร์ {phone_short} ของท่านจะถูกระงับ กรุณายืนยันที่ {url}",
    "กรมสรรพากรแจ้ง: ท่านมีเงินคืนภาษี {prize} บาท กรอกข้อมูลรับเงิน: {url}",
    "ตำรวจไซเบอร์แจ้ง: บัญชีของท่านเกี่ยวข้องกับคดีฟอกเงิน โทร {phone} ทันที",
    "เจ้าหน้าที่ประกันสังคมแจ้ง: ท่านมีสิทธิ์รับเงิน {prize} บาท ยืนยัน: {url}",
    "True Money: บัญชีของท่านจะถูกปิด กรุณากรอก OTP {otp} เพื่อยืนยัน",
    "ธนาคาร{bank}: พบการใช้บัตรผิดปกติที่ {location} โทรยืนยัน {phone} ทันที",
    "iCloud แจ้ง: Apple ID ของคุณถูกล็อก กรุณายืนยันผ่าน: {url}",
    "Facebook แจ้ง: บัญชีของคุณอาจถูกแฮก ยืนยันตัวตนที่: {url} ภายใน {time} นาที",
    "ส่งพัสดุไม่ได้ เนื่องจากที่อยู่ไม่ครบ กรุณายืนยัน: {url} มิฉะนั้นพัสดุจะถูกส่งคืน",
    "แจ้งเตือน! พบไวรัสในโทรศัพท์ กดทันทีเพื่อลบ: {url} ก่อนข้อมูลสูญหาย",
    "เจ้าหน้าที่กรุงเทพมหานคร: ท่านค้างค่าปรับ {prize} บาท ชำระที่ {url} หรือโทร {phone}",
    "โปรดยืนยัน: รหัส OTP {otp} ใช้สำหรับการทำธุรกรรม {prize} บาท ที่ธนาคาร{bank}",
    "ด่วนมาก! บัตร ATM ของท่านจะหมดอายุพรุ่งนี้ ต่ออายุออนไลน์: {url}",
    "เจ้าหน้าที่ศาล: ท่านมีหมายเรียก กรุณาติดต่อ {phone} ภายใน {time} ชั่วโมง",
]

FAQ_ANSWERS = {
    "สแปมคืออะไร": "**สแปม** คือข้อความที่ถูกส่งมาโดยไม่ได้ขออนุญาต มักเป็นโฆษณา หรือชักชวนสิ่งที่ไม่ต้องการ\n\n**ตัวอย่าง:**\n• ข้อความโปรโมชั่น ลด 50%\n• แจ้งว่าได้รับรางวัลที่ไม่ได้สมัคร\n• ชักชวนสมัครสินเชื่อ/ประกัน\n\n**วิธีรับมือ:** ไม่ต้องตอบ ลบทิ้ง หรือบล็อกเบอร์นั้น",
    "ฟิชชิ่งคืออะไร": "**ฟิชชิ่ง** คือการหลอกลวงเพื่อขโมยข้อมูลส่วนตัว เช่น รหัสบัตร รหัส OTP หรือรหัสผ่าน\n\n**สัญญาณเตือน:**\n• แอบอ้างเป็นธนาคาร ตำรวจ หรือหน่วยงานราชการ\n• ขู่ว่าบัญชีจะถูกระงับถ้าไม่ดำเนินการด่วน\n• ขอ OTP รหัสผ่าน หรือข้อมูลส่วนตัว\n• มีลิงก์ URL ที่ดูแปลกหรือสั้น เช่น bit.ly/...\n\n**วิธีรับมือ:** อย่ากดลิงก์ อย่าให้ข้อมูลใดๆ โทร 1599 ถ้าสงสัย",
    "ถูกหลอกแล้วทำอย่างไร": "ถ้าเพิ่งถูกหลอก ให้ทำทันทีตามขั้นตอนนี้:\n\n**1. อายัดบัญชีก่อนเลย**\n• โทรหาธนาคารที่หลังบัตร หรือผ่านแอปธนาคาร\n• ขอระงับบัตร/บัญชีชั่วคราว\n\n**2. แจ้งความ**\n• โทร 1599 (สายด่วนไซเบอร์) ได้ทันที ฟรี 24 ชม.\n• หรือไปแจ้งที่สถานีตำรวจใกล้บ้าน\n\n**3. เก็บหลักฐาน**\n• ถ่ายรูปหน้าจอข้อความ/บทสนทนา\n• จดเบอร์โทร บัญชีที่โอนเงิน ลิงก์ที่กด\n\n**4. เปลี่ยนรหัสผ่าน**\n• เปลี่ยนรหัสแอปธนาคาร อีเมล LINE ทั้งหมด",
    "วิธีสังเกตข้อความอันตราย": "**สัญญาณอันตราย ให้ระวัง:**\n\n🚨 **อันตรายมาก:**\n• ขอ OTP รหัสผ่าน หรือเลขบัตร\n• ขู่ว่าบัญชีจะถูกปิด/อายัด\n• แอบอ้างเป็นธนาคาร ตำรวจ ศาล หรือราชการ\n\n⚠️ **น่าสงสัย:**\n• มีรางวัลหรือเงินที่ไม่ได้สมัคร\n• มีลิงก์แปลกๆ หรือ URL สั้น\n• เร่งรัดให้ทำอะไรภายในเวลาจำกัด\n• มีเบอร์โทรที่ไม่รู้จัก\n\n✅ **ถ้าสงสัย:** อย่าตอบ อย่ากด โทรถามคนที่ไว้ใจหรือโทร 1599",
    "otp คืออะไร": "**OTP** (One-Time Password) คือรหัสที่ใช้ได้ครั้งเดียว มักส่งผ่าน SMS\n\n**ข้อควรจำ:**\n• ธนาคารจะ **ไม่มีวัน** โทรขอ OTP จากคุณ\n• OTP ที่แท้จริงคุณต้องขอมาเอง ไม่ใช่ระบบส่งมาให้แล้วขอ\n• ถ้าใครขอ OTP → **เป็นมิจฉาชีพ 100%**\n\n**สิ่งที่ต้องทำ:** วางสายทันที อย่าบอก OTP กับใครเลย",
    "สายด่วน": "**หมายเลขสายด่วนที่ควรจำ:**\n\n📞 **1599** — สายด่วนไซเบอร์ (DSI) ฟรี 24 ชั่วโมง\n📞 **1213** — ธนาคารแห่งประเทศไทย\n📞 **191** — ตำรวจ (เหตุฉุกเฉิน)\n📞 **1202** — DSI กรมสอบสวนคดีพิเศษ\n\n**แนะนำ:** บันทึกเบอร์ 1599 ไว้ในโทรศัพท์เดี๋ยวนี้เลยครับ/ค่ะ",
}

SECOND_OPINION_PROMPT = """คุณเป็นผู้เชี่ยวชาญด้านความปลอดภัยไซเบอร์ที่เชี่ยวชาญข้อความภาษาไทย
หน้าที่ของคุณคือจำแนกข้อความ SMS/LINE เป็น 1 ในสามประเภท:
- "ham" = ข้อความปกติ ไม่เป็นอันตราย (เช่น ข้อความครอบครัว แจ้งข่าวจากธนาคารจริง นัดหมอ)
- "spam" = สแปม โฆษณา หรือข้อความชักชวนที่ไม่พึงประสงค์ (เช่น แจ้งรางวัล โปรโมชั่นหลอกลวง สินเชื่อด่วน)
- "phishing" = ฟิชชิ่ง หลอกลวงเพื่อขโมยข้อมูลส่วนตัว (เช่น ขอ OTP ขู่ระงับบัญชี แอบอ้างเป็นธนาคาร/ตำรวจ/กรมสรรพากร)

สัญญาณสำคัญของ phishing:
- มีการขอ OTP รหัสผ่าน หรือข้อมูลส่วนตัว
- ขู่ว่าบัญชีจะถูกระงับ/ปิด ถ้าไม่ดำเนินการ
- มีลิงก์ URL ที่ดูน่าสงสัยหรือไม่ใช่เว็บไซต์ทางการ
- แอบอ้างเป็นธนาคาร ตำรวจ ศาล หรือหน่วยงานราชการ

ตอบเฉพาะ JSON ในรูปแบบนี้เท่านั้น ห้ามมีข้อความอื่น:
{"label": "ham", "confidence": 0.95, "reason": "เหตุผลสั้นๆ เป็นภาษาไทย ไม่เกิน 2 ประโยค"}"""
