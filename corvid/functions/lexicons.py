"""Words of Vietnamese legal text. Any of the tables can be replaced by one read from a file."""

from __future__ import annotations

import json

# Short forms in stored texts and what they stand for, the longest first when applied.
ABBREVIATIONS: dict[str, str] = {
    "BLHS": "Bộ Luật Hình Sự", "BLDS": "Bộ Luật Dân Sự", "BLTTHS": "Bộ Luật Tố Tụng Hình Sự", "BLTTDS": "Bộ Luật Tố Tụng Dân Sự", "BLLĐ": "Bộ Luật Lao Động",
    "NĐ-CP": "Nghị định Chính phủ", "NĐ": "Nghị định", "NĐCP": "Nghị định Chính phủ",
    "TT": "Thông tư", "TT-BTC": "Thông tư Bộ Tài chính", "TT-BTP": "Thông tư Bộ Tư pháp", "TT-BCT": "Thông tư Bộ Công thương",
    "TT-BLĐTBXH": "Thông tư Bộ Lao động Thương binh và Xã hội", "TT-NHNN": "Thông tư Ngân hàng Nhà nước", "TT-BGDĐT": "Thông tư Bộ Giáo dục và Đào tạo",
    "TT-BYT": "Thông tư Bộ Y tế", "TT-BXD": "Thông tư Bộ Xây dựng", "TT-BTNMT": "Thông tư Bộ Tài nguyên và Môi trường", "TT-BTTTT": "Thông tư Bộ Thông tin và Truyền thông",
    "TT-BQP": "Thông tư Bộ Quốc phòng", "TT-BNG": "Thông tư Bộ Ngoại giao", "TT-BCA": "Thông tư Bộ Công an", "TT-BNNPTNT": "Thông tư Bộ Nông nghiệp và Phát triển nông thôn",
    "QĐ": "Quyết định", "QĐ-TTg": "Quyết định Thủ tướng Chính phủ", "QĐ-UBND": "Quyết định Ủy ban nhân dân",
    "NQ": "Nghị quyết", "NQ-TVQH": "Nghị quyết Thường vụ Quốc hội", "NQ-CP": "Nghị quyết Chính phủ",
    "LĐ": "Luật", "PL": "Pháp lệnh", "Hiến pháp": "Hiến pháp", "HP": "Hiến pháp",
    "CP": "Chính phủ", "QH": "Quốc hội", "TVQH": "Thường vụ Quốc hội", "UBTVQH": "Ủy ban Thường vụ Quốc hội", "TTg": "Thủ tướng", "TTG": "Thủ tướng Chính phủ",
    "BTC": "Bộ Tài chính", "BTP": "Bộ Tư pháp", "BCT": "Bộ Công thương", "BLĐTBXH": "Bộ Lao động Thương binh và Xã hội", "NHNN": "Ngân hàng Nhà nước",
    "BGDĐT": "Bộ Giáo dục và Đào tạo", "BYT": "Bộ Y tế", "BXD": "Bộ Xây dựng", "BTNMT": "Bộ Tài nguyên và Môi trường", "BTTTT": "Bộ Thông tin và Truyền thông",
    "BQP": "Bộ Quốc phòng", "BNG": "Bộ Ngoại giao", "BCA": "Bộ Công an", "BNNPTNT": "Bộ Nông nghiệp và Phát triển nông thôn", "UBND": "Ủy ban nhân dân",
    "HS": "Hình sự", "DS": "Dân sự", "HC": "Hành chính", "HĐ": "Hợp đồng", "HĐLĐ": "Hợp đồng lao động", "HĐMB": "Hợp đồng mua bán", "HĐDV": "Hợp đồng dịch vụ",
    "KCN": "Khu công nghiệp", "KCX": "Khu chế xuất", "DN": "Doanh nghiệp", "DNNN": "Doanh nghiệp nhà nước", "DNTN": "Doanh nghiệp tư nhân", "TNHH": "Trách nhiệm hữu hạn",
    "CĐ": "Công đoàn", "CĐDC": "Công đoàn độc lập", "NLĐ": "NgườI lao động", "NSDLĐ": "NgườI sử dụng lao động",
    "BHXH": "Bảo hiểm xã hội", "BHYT": "Bảo hiểm y tế", "BHTN": "Bảo hiểm thất nghiệp", "TNCN": "Thu nhập cá nhân", "GTGT": "Giá trị gia tăng", "TNDN": "Thu nhập doanh nghiệp",
    "XK": "Xuất khẩu", "NK": "Nhập khẩu", "XNK": "Xuất nhập khẩu", "TM": "Thương mại", "ĐT": "Đầu tư", "ĐKKD": "Đăng ký kinh doanh", "GPKD": "Giấy phép kinh doanh",
    "CMND": "Chứng minh nhân dân", "CCCD": "Căn cước công dân", "TTHC": "Thủ tục hành chính", "VP": "Vi phạm", "XPHC": "Xử phạt hành chính", "HSVPHC": "Hành vi vi phạm hành chính",
}

# Short forms in queries, in the order in which they are applied.
QUERY_ABBREVIATIONS: dict[str, str] = {
    "BLHS": "Bộ Luật Hình Sự", "BLDS": "Bộ Luật Dân Sự", "BLTTHS": "Bộ Luật Tố Tụng Hình Sự", "BLTTDS": "Bộ Luật Tố Tụng Dân Sự",
    "BLHS2015": "Bộ Luật Hình Sự năm 2015", "BLDS2015": "Bộ Luật Dân Sự năm 2015", "BLDS2005": "Bộ Luật Dân Sự năm 2005", "BLHS1999": "Bộ Luật Hình Sự năm 1999",
    "BLHS2009": "Bộ Luật Hình Sự năm 2009", "BLTTDS2004": "Bộ Luật Tố Tụng Dân Sự năm 2004", "BLTTHS2003": "Bộ Luật Tố Tụng Hình Sự năm 2003",
    "BLLĐ": "Bộ Luật Lao Động", "BLLD": "Bộ Luật Lao Động", "BLLĐ2019": "Bộ Luật Lao Động năm 2019", "BLLĐ2012": "Bộ Luật Lao Động năm 2012",
    "BLTM": "Bộ Luật Thương Mại", "BLTM2005": "Bộ Luật Thương Mại năm 2005", "LDT": "Luật Doanh Nghiệp", "LDN": "Luật Doanh Nghiệp",
    "LDN2020": "Luật Doanh Nghiệp năm 2020", "LDN2014": "Luật Doanh Nghiệp năm 2014", "LDN2005": "Luật Doanh Nghiệp năm 2005",
    "LĐT": "Luận Đầu Tư", "LĐT2020": "Luật Đầu Tư năm 2020", "LĐT2014": "Luật Đầu Tư năm 2014",
    "LHN": "Luật Hôn Nhân", "LHN&GĐ": "Luật Hôn Nhân và Gia Đình", "LHN2014": "Luật Hôn Nhân và Gia Đình năm 2014",
    "LĐĐ": "Luật Đất Đai", "LĐĐ2013": "Luật Đất Đai năm 2013", "LĐĐ2003": "Luật Đất Đai năm 2003", "LN": "Luật Nhà ở", "LN2014": "Luật Nhà ở năm 2014", "LN2005": "Luật Nhà ở năm 2005",
    "LGTGT": "Luật Giá Trị Gia Tăng", "LTNCN": "Luật Thuế Thu Nhập Cá Nhân", "LTNCN2007": "Luật Thuế Thu Nhập Cá Nhân năm 2007",
    "LTNTDN": "Luật Thuế Thu Nhập Doanh Nghiệp", "LTNTDN2008": "Luật Thuế Thu Nhập Doanh Nghiệp năm 2008",
    "LSHTT": "Luật Sở Hữu Trí Tuệ", "LSHTT2005": "Luật Sở Hữu Trí Tuệ năm 2005",
    "LCT": "Luật Cạnh Tranh", "LCT2018": "Luật Cạnh Tranh năm 2018", "LCT2004": "Luật Cạnh Tranh năm 2004", "LBVNTD": "Luật Bảo Vệ NgườI Tiêu Dùng",
    "NĐ-CP": "Nghị Định Chính Phủ", "NĐ": "Nghị Định", "CP": "Chính Phủ",
    "TT-BLĐTBXH": "Thông Tư Bộ Lao Động Thương Binh và Xã Hội", "TT-BTC": "Thông Tư Bộ Tài Chính", "TT-BTP": "Thông Tư Bộ Tư Pháp",
    "TT-BTNMT": "Thông Tư Bộ Tài Nguyên và Môi Trường", "TT-BXD": "Thông Tư Bộ Xây Dựng", "TT-BCT": "Thông Tư Bộ Công Thương", "TT-BYT": "Thông Tư Bộ Y Tế",
    "TT-BGDĐT": "Thông Tư Bộ Giáo Dục và Đào Tạo", "TT-BTTTT": "Thông Tư Bộ Thông Tin và Truyền Thông", "TT-BQP": "Thông Tư Bộ Quốc Phòng", "TT-BNV": "Thông Tư Bộ Nội Vụ",
    "TT-BKHCN": "Thông Tư Bộ Khoa Học và Công Nghệ", "TT-BKHĐT": "Thông Tư Bộ Kế Hoạch và Đầu Tư", "TT-BGTVT": "Thông Tư Bộ Giao Thông Vận Tải",
    "TT-BNNPTNT": "Thông Tư Bộ Nông Nghiệp và Phát Triển Nông Thôn", "TT-BVHTTDL": "Thông Tư Bộ Văn Hóa Thể Thao và Du Lịch", "TT": "Tái Thẩm",
    "QĐ": "Quyết Định", "NQ": "Nghị Quyết", "TB": "Thông Báo", "CV": "Công Văn", "CT": "Chỉ Thị", "KL": "Kết Luận", "TTg": "Thủ Tướng Chính Phủ", "UBND": "Ủy Ban Nhân Dân",
    "HĐND": "Hội Đồng Nhân Dân", "QH": "Quốc Hội", "TAND": "Tòa Án Nhân Dân", "VKSND": "Viện Kiểm Sát Nhân Dân", "ST": "Sơ Thẩm", "PT": "Phúc Thẩm", "GQ": "Giám Đốc Thẩm",
}

# Words that queries use for one another.
SYNONYMS: dict[str, list[str]] = {
    "công ty": ["doanh nghiệp", "tổ chức kinh tế", "doanh nghiệp tư nhân", "hợp danh", "cổ phần"],
    "doanh nghiệp": ["công ty", "tổ chức kinh tế"],
    "tổ chức kinh tế": ["công ty", "doanh nghiệp"],
    "nhân viên": ["ngườI lao động", "công nhân", "ngườI làm công", "ngườI được tuyển dụng"],
    "ngườI lao động": ["nhân viên", "công nhân", "ngườI làm công"],
    "công nhân": ["nhân viên", "ngườI lao động"],
    "bảo hiểm": ["bảo hiểm xã hội", "bảo hiểm y tế", "bảo hiểm thất nghiệp"],
    "bảo hiểm xã hội": ["bảo hiểm", "bhxh"],
    "bhxh": ["bảo hiểm xã hội", "bảo hiểm"],
    "không được": ["cấm", "nghiêm cấm", "không được phép", "không cho phép", "không có quyền"],
    "cấm": ["không được", "nghiêm cấm", "không được phép", "không cho phép"],
    "nghiêm cấm": ["cấm", "không được", "không được phép"],
    "không được phép": ["không được", "cấm", "nghiêm cấm"],
    "hợp đồng": ["giao kết", "thỏa thuận", "cam kết", "hợp đồng lao động"],
    "giao kết": ["hợp đồng", "thỏa thuận"],
    "thỏa thuận": ["hợp đồng", "giao kết", "cam kết"],
    "vi phạm": ["xâm phạm", "trái quy định", "không tuân thủ", "phạm tội"],
    "xâm phạm": ["vi phạm", "trái quy định"],
    "trái quy định": ["vi phạm", "xâm phạm", "không tuân thủ"],
    "bồi thường": ["đền bù", "bồi thường thiệt hại"],
    "đền bù": ["bồi thường", "bồi thường thiệt hại"],
    "chấm dứt": ["hủy bỏ", "thanh lý", "đơn phương chấm dứt", "chấm dứt hợp đồng"],
    "hủy bỏ": ["chấm dứt", "thanh lý", "vô hiệu"],
    "thanh lý": ["chấm dứt", "hủy bỏ", "giải quyết hậu quả"],
    "quyền": ["quyền lợi", "lợi ích", "quyền hạn"],
    "nghĩa vụ": ["trách nhiệm", "bổn phận"],
    "trách nhiệm": ["nghĩa vụ", "bổn phận"],
    "điều khoản": ["khoản", "điểm", "điều luật"],
    "khoản": ["điều khoản", "điểm"],
    "điểm": ["khoản", "điều khoản"],
    "bên": ["bên A", "bên B", "các bên", "đối tác"],
    "các bên": ["bên", "đối tác"],
    "thờI hạn": ["kỳ hạn", "thờI gian", "hạn"],
    "kỳ hạn": ["thờI hạn", "thờI gian"],
    "lương": ["tiền lương", "tiền công", "thù lao"],
    "tiền lương": ["lương", "tiền công"],
    "giờ làm việc": ["thờI gian làm việc", "ca làm việc"],
    "thờI gian làm việc": ["giờ làm việc", "ca làm việc"],
    "nghỉ phép": ["nghỉ hằng năm", "nghỉ có lương", "nghỉ phép năm"],
    "nghỉ hằng năm": ["nghỉ phép", "nghỉ phép năm"],
}

# Other forms of verbs; they replace parts of words too.
VERBS: dict[str, list[str]] = {
    "quản lý": ["được quản lý", "việc quản lý", "công tác quản lý"],
    "thành lập": ["được thành lập", "việc thành lập"],
    "cung cấp": ["được cung cấp", "việc cung cấp"],
    "quy định": ["được quy định", "theo quy định", "các quy định"],
    "báo cáo": ["việc báo cáo", "chế độ báo cáo"],
    "thanh toán": ["việc thanh toán", "được thanh toán"],
    "sử dụng": ["được sử dụng", "việc sử dụng", "quyền sử dụng"],
    "bảo vệ": ["được bảo vệ", "việc bảo vệ", "công tác bảo vệ"],
    "kiểm tra": ["được kiểm tra", "việc kiểm tra", "công tác kiểm tra"],
    "giám sát": ["được giám sát", "việc giám sát", "công tác giám sát"],
    "xử lý": ["được xử lý", "việc xử lý"],
    "phê duyệt": ["được phê duyệt", "việc phê duyệt"],
    "cấp phép": ["được cấp phép", "việc cấp phép", "giấy phép"],
    "đăng ký": ["được đăng ký", "việc đăng ký", "thủ tục đăng ký"],
    "thu phí": ["việc thu phí", "mức thu phí"],
    "giao đất": ["được giao đất", "việc giao đất"],
    "trồng rừng": ["việc trồng rừng", "công tác trồng rừng"],
}

# Narrower terms of broad ones; they replace parts of words too.
CONCEPTS: dict[str, list[str]] = {
    "phí dịch vụ": ["giá dịch vụ", "lệ phí", "phí bến bãi", "mức phí", "biểu phí"],
    "giá cả": ["giá dịch vụ", "niêm yết giá", "quy định giá", "mức giá"],
    "đất đai": ["đất lâm nghiệp", "đất nông nghiệp", "quyền sử dụng đất", "quản lý đất"],
    "tài nguyên": ["tài nguyên thiên nhiên", "môi trường", "khoáng sản", "rừng"],
    "tổ chức bộ máy": ["cơ cấu tổ chức", "bộ máy hành chính", "phân cấp quản lý", "nhân sự"],
    "ban quản lý": ["ban quản lý dự án", "ban điều hành", "hội đồng quản lý"],
    "thủ tục hành chính": ["thủ tục hành chính công", "giấy phép", "đăng ký", "cấp phép"],
    "báo cáo": ["báo cáo định kỳ", "chế độ báo cáo", "báo cáo tài chính"],
    "hợp đồng": ["giao kết hợp đồng", "thực hiện hợp đồng", "điều khoản hợp đồng"],
    "xử phạt": ["xử phạt vi phạm", "xử phạt hành chính", "chế tài"],
    "môi trường": ["bảo vệ môi trường", "phục hồi môi trường", "ký quỹ môi trường", "ô nhiễm"],
    "ngân sách": ["ngân sách nhà nước", "thu chi ngân sách", "tài chính công"],
    "đầu tư": ["dự án đầu tư", "vốn đầu tư", "quản lý đầu tư"],
    "giữ xe": ["dịch vụ giữ xe", "phí giữ xe", "bến bãi", "trông giữ xe"],
    "niêm yết": ["niêm yết giá", "niêm yết công khai", "công bố"],
    "phục hồi": ["phục hồi môi trường", "ký quỹ phục hồi", "cải tạo phục hồi"],
    "lâm nghiệp": ["đất lâm nghiệp", "rừng", "trồng rừng", "quản lý rừng"],
}


def read(path: str) -> dict:
    """A table from a JSON file: an object of strings (short forms), or of lists of strings."""
    with open(path, encoding="utf-8") as f:
        table = json.load(f)
    if not isinstance(table, dict) or not all(isinstance(v, str) or (isinstance(v, list) and all(isinstance(x, str) for x in v)) for v in table.values()):
        raise ValueError(f"{path} is no object of strings or of lists of strings")
    return table
