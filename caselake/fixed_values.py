"""Fixed values of the data product: names, patterns, limits and texts that
results depend on. They are data, kept together and in plain form."""

# --- fixed values: source columns -------------------------------------------------
DAILY_COLUMNS = [
    "iso_code", "continent", "location", "date",
    "new_cases", "new_deaths", "total_cases", "total_deaths",
    "people_vaccinated", "population",
]
DAILY_MEASURES = [
    "new_cases", "new_deaths", "total_cases", "total_deaths",
    "people_vaccinated", "population",
]
PROVINCE_HEADERS = {
    "Tỉnh": "province_name",
    "Tổng số ca lây nhiễm": "total_cases",
    "Số ca lây nhiễm mới": "new_cases",
    "Tổng số ca tử vong": "total_deaths",
    "Ngày": "date_raw",
}
# keyword in the header -> column, first match wins
LOCALITY_HEADERS = [
    ("locality", "province_name"),
    ("population", "population"),
    ("distributed", "doses_distributed"),
    ("administered per 100", "doses_per_100"),
    ("administered", "doses_administered"),
]
LOCALITY_REQUIRED = ["province_name", "population", "doses_distributed", "doses_administered"]
LOCALITY_TABLE_WORDS = ["locality", "doses administered"]

# --- fixed values: codes and words ------------------------------------------------
AGGREGATE_PREFIX = "OWID_"
HEADER_ECHO = "iso_code"
BLANK_NUMBER_WORDS = ["-", "—", "nan"]
TOTAL_LABEL = "Cả nước"
PROVINCE_SUFFIX = " province"
NULL_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]
JOB_STATUSES = ["success", "failed", "running"]

# --- fixed values: dates and limits -----------------------------------------------
ISO_DATE = "yyyy-MM-dd"
SHORT_ISO_DATE = "yyyy-M-d"
TOLERANT_DATES = ["yyyy-MM-dd", SHORT_ISO_DATE, "d/M/yyyy"]
TIME_OF_DAY = r"[T ]\d{1,2}:\d{2}(:\d{2}([.]\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
PROVINCE_DATES = ["MM-dd-yyyy", "M-d-yyyy"]
TIMELINE_DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
DAYS_TO_KEEP = 400
TREND_DAYS = 7
CLASS_CUTS = [0.82, 0.64, 0.46, 0.28]
DOWNSAMPLE_STEPS = [(45, 1), (120, 7)]
DOWNSAMPLE_LAST_STEP = 30
DAY_LABEL = "dd/MM/yyyy"
MONTH_LABEL = "MM/yyyy"

# --- fixed values: place key alias ------------------------------------------------
PLACE_KEY_ALIASES = {"hochiminhcity": "hochiminh"}

# --- fixed values: place -> (longitude, latitude) ---------------------------------
PLACE_COORDINATES = {
    "ha noi": (105.85, 21.03), "ho chi minh city": (106.63, 10.82), "hai phong": (106.68, 20.86),
    "da nang": (108.22, 16.07), "can tho": (105.78, 10.05), "an giang": (105.17, 10.52),
    "ba ria-vung tau": (107.24, 10.54), "bac giang": (106.20, 21.28), "bac kan": (105.84, 22.15),
    "bac lieu": (105.72, 9.29), "bac ninh": (106.08, 21.19), "ben tre": (106.38, 10.24),
    "binh dinh": (109.22, 13.77), "binh duong": (106.67, 11.17), "binh phuoc": (106.89, 11.75),
    "binh thuan": (108.10, 10.93), "ca mau": (105.15, 9.18), "cao bang": (106.26, 22.67),
    "dak lak": (108.04, 12.67), "dak nong": (107.69, 12.00), "dien bien": (103.02, 21.39),
    "dong nai": (107.17, 10.95), "dong thap": (105.64, 10.46), "gia lai": (108.00, 13.98),
    "ha giang": (104.98, 22.83), "ha nam": (105.92, 20.54), "ha tinh": (105.90, 18.34),
    "hai duong": (106.32, 20.94), "hau giang": (105.64, 9.78), "hoa binh": (105.34, 20.82),
    "hung yen": (106.05, 20.65), "khanh hoa": (109.20, 12.26), "kien giang": (105.13, 10.02),
    "kon tum": (108.00, 14.35), "lai chau": (103.46, 22.40), "lam dong": (108.44, 11.94),
    "lang son": (106.76, 21.85), "lao cai": (104.00, 22.48), "long an": (106.17, 10.54),
    "nam dinh": (106.17, 20.42), "nghe an": (104.92, 19.23), "ninh binh": (105.97, 20.25),
    "ninh thuan": (108.99, 11.57), "phu tho": (105.22, 21.32), "phu yen": (109.09, 13.09),
    "quang binh": (106.60, 17.47), "quang nam": (108.33, 15.57), "quang ngai": (108.80, 15.12),
    "quang ninh": (107.29, 21.01), "quang tri": (107.19, 16.75), "soc trang": (105.97, 9.60),
    "son la": (103.91, 21.33), "tay ninh": (106.13, 11.31), "thai binh": (106.34, 20.45),
    "thai nguyen": (105.84, 21.59), "thanh hoa": (105.78, 19.81), "thua thien-hue": (107.59, 16.46),
    "tien giang": (106.35, 10.45), "tra vinh": (106.34, 9.93), "tuyen quang": (105.22, 21.82),
    "vinh long": (105.97, 10.25), "vinh phuc": (105.60, 21.31), "yen bai": (104.87, 21.72),
}

# --- fixed values: message rules (label, keywords, reply), first match wins -------
MESSAGE_RULES = [
    (
        "emergency",
        ["khó thở", "dau nguc", "đau ngực", "tim tái", "ngất", "co giật", "cấp cứu"],
        "Nếu có dấu hiệu khó thở, đau ngực, tím tái, ngất hoặc tình trạng nặng lên nhanh, "
        "hãy gọi cấp cứu 115 hoặc đến cơ sở y tế gần nhất ngay. Thông tin này chỉ để tham khảo, "
        "không thay thế chẩn đoán của bác sĩ.",
    ),
    (
        "symptoms",
        ["triệu chứng", "trieu chung", "dấu hiệu", "dau hieu"],
        "Triệu chứng COVID-19 thường gặp gồm sốt, ho, đau họng, nghẹt mũi, mệt mỏi, đau đầu, "
        "đau cơ, mất vị giác/khứu giác và đôi khi tiêu chảy. Một số dấu hiệu cần đi khám sớm là "
        "khó thở, đau tức ngực, lơ mơ, tím môi hoặc sốt cao kéo dài. Đây là thông tin tham khảo.",
    ),
    (
        "prevention",
        ["phòng", "phong", "ngừa", "ngua", "tránh", "tranh"],
        "Để giảm nguy cơ lây nhiễm, nên tiêm vaccine theo khuyến cáo, đeo khẩu trang ở nơi đông người "
        "hoặc không gian kín, rửa tay thường xuyên, giữ thông khí tốt và ở nhà khi có triệu chứng hô hấp. "
        "Thông tin này không thay thế tư vấn y tế cá nhân.",
    ),
    (
        "testing",
        ["test", "xét nghiệm", "xet nghiem"],
        "Bạn nên xét nghiệm khi có triệu chứng nghi COVID-19, sau tiếp xúc gần với ca bệnh, hoặc khi cần "
        "bảo vệ người có nguy cơ cao. Nếu kết quả âm tính nhưng triệu chứng vẫn rõ, có thể xét nghiệm lại "
        "sau 24-48 giờ hoặc hỏi cơ sở y tế.",
    ),
    (
        "isolation",
        ["cách ly", "cach ly", "dương tính", "duong tinh"],
        "Nếu dương tính, hãy hạn chế tiếp xúc, đeo khẩu trang khi ở gần người khác, nghỉ ngơi, uống đủ nước "
        "và theo dõi triệu chứng. Người có bệnh nền, người cao tuổi, phụ nữ mang thai hoặc có dấu hiệu nặng "
        "nên liên hệ nhân viên y tế.",
    ),
]
DEFAULT_MESSAGE_RULE = (
    "default",
    "Mình có thể hỗ trợ thông tin tổng quát về COVID-19 như triệu chứng, phòng ngừa, xét nghiệm, cách ly "
    "và khi nào nên đi khám. Bạn mô tả rõ hơn câu hỏi nhé. Lưu ý: đây là thông tin tham khảo, không thay thế "
    "chẩn đoán hoặc điều trị từ bác sĩ.",
)
