"""Word lists, lookup tables, weights and patterns that define the expected results.

Everything here is a constant of the rule set, so its size never grows with the data.
"""

from __future__ import annotations

# --- hosts --------------------------------------------------------------------------------------

# fixed values: text that marks a "host" as a local path or an API marker
LOCAL_HOST_MARKERS = ["/", "\\", ".txt", ".json", ".xml", ".db", ".log", ".tmp", ".cache",
                      "files-", "fs-", "LOCAL_FILE", "CryptoAPI"]
INTERNAL_HOST_PREFIXES = ["localhost", "127.0.0.1", "192.168.", "10.42.0.1", "10.0.2.2"]
PLACEHOLDER_HOSTS = ["Unknown", "LOCAL_FILE_SYSTEM"]

# fixed values: host suffixes that are not probed
SKIPPED_HOST_SUFFIXES = [
    "googleadservices.com", "googleusercontent.com", "googlesyndication.com", "googlevideo.com",
    "google-analytics.com", "google.com", "googleapis.com", "gvt1.com", "doubleclick.net",
    "googletagservices.com", "googletagmanager.com", "google.ca", "google.ru", "3gppnetwork.org",
    "gstatic.com", "youtube.com", "googlezip.net", "app-measurement.com", "gvt2.com",
]

# fixed values: media handling
BULKY_RESPONSE_TYPES = ["image/png", "image/jpeg", "image/webp", "text/css", "image/gif", "application/zip",
                        "image/x-icon", "JPG", "audio/mpeg", "video/mpeg"]
MEDIA_TYPES = ["image", "video", "audio", "octet-stream"]
MEDIA_SUFFIXES = [".jpg", ".jpeg", ".png", ".gif", ".mp4", ".webm", ".zip", ".rar"]
STRIPPED_BODY = "Content Stripped by Script"

# fixed values: hosts that are passed through without inspection
TLS_PASSTHROUGH_HOSTS = ["wtzw.com", "qm989.com", "qq.com", "tencent.com", "qlogo.cn", "gtimg.cn", "kuaishou.com",
                         "e.kuaishou.com", "mob.com", "umeng.com", "amap.com", "alicdn.com"]

# fixed values: package parts that say nothing about the owner
GENERIC_PACKAGE_PARTS = ["com", "cn", "org", "net", "android", "app"]

# fixed values: ordered (pattern, SDK name, company)
SDK_HOST_PATTERNS = [
    (r".*\.baidu\.com$", "百度SDK", "百度"),
    (r".*\.qq\.com$", "腾讯SDK", "腾讯"),
    (r".*\.tencent\.com$", "腾讯SDK", "腾讯"),
    (r".*\.aliyun\.com$", "阿里云SDK", "阿里巴巴"),
    (r".*\.alibaba\.com$", "阿里SDK", "阿里巴巴"),
    (r".*\.taobao\.com$", "淘宝SDK", "阿里巴巴"),
    (r".*\.umeng\.com$", "友盟SDK", "友盟"),
    (r".*\.umengcloud\.com$", "友盟SDK", "友盟"),
    (r".*\.jpush\.cn$", "极光推送", "极光"),
    (r".*\.jiguang\.cn$", "极光SDK", "极光"),
    (r".*\.getui\.com$", "个推SDK", "个推"),
    (r".*\.igexin\.com$", "个推SDK", "个推"),
    (r".*\.mob\.com$", "Mob SDK", "Mob"),
    (r".*\.sensors.*\.com$", "神策SDK", "神策"),
    (r".*\.growingio\.com$", "GrowingIO", "GrowingIO"),
    (r".*\.bugly\..*$", "Bugly", "腾讯"),
    (r".*\.crashlytics\..*$", "Crashlytics", "Google"),
    (r".*\.firebase\..*$", "Firebase", "Google"),
    (r".*\.google\..*$", "Google SDK", "Google"),
    (r".*\.facebook\..*$", "Facebook SDK", "Meta"),
    (r".*\.huawei\.com$", "华为SDK", "华为"),
    (r".*\.hicloud\.com$", "华为云", "华为"),
    (r".*\.xiaomi\.com$", "小米SDK", "小米"),
    (r".*\.miui\.com$", "小米SDK", "小米"),
    (r".*\.oppo\.com$", "OPPO SDK", "OPPO"),
    (r".*\.vivo\.com$", "vivo SDK", "vivo"),
    (r".*\.meizu\.com$", "魅族SDK", "魅族"),
    (r".*\.bytedance\.com$", "字节SDK", "字节跳动"),
    (r".*\.snssdk\.com$", "字节SDK", "字节跳动"),
    (r".*\.pstatp\.com$", "字节SDK", "字节跳动"),
]

# --- leaks --------------------------------------------------------------------------------------

# fixed values: categories of an unmapped field
DEFAULT_LEVEL1 = "其他信息"
DEFAULT_LEVEL2 = "未分类"
LOCAL_SOURCES = ["file_buffer", "whole_file", "crypt_direct"]
NETWORK_SOURCES = ["http", "https"]
# fixed values: keywords whose payload is remembered as a token
TOKEN_KEYWORDS = ["token-word", "session-word", "cookie-word", "authorization-word", "secret-word",
                  "password-word", "jwt-word"]
HASH_ENCODINGS = ["md5hex", "sha1hex", "sha256hex", "md5", "sha1", "sha256"]

# fixed values: risk words
HIGH_RISK_WORDS = ["imei", "imsi", "phone", "contacts", "sms", "call_log", "location", "gps", "password", "token",
                   "身份证", "手机号"]
MEDIUM_RISK_WORDS = ["android_id", "mac", "wifi", "installed_apps", "account", "email", "device_id", "oaid",
                     "设备标识"]

# --- API calls ----------------------------------------------------------------------------------

# fixed values: content URIs by kind, in matching order
SENSITIVE_URIS = {
    "contacts": ["content://com.android.contacts", "content://contacts", "contactscontract"],
    "calllog": ["content://call_log", "content://calls", "calllog.calls"],
    "sms": ["content://sms", "content://mms", "content://mms-sms"],
    "calendar": ["content://com.android.calendar", "calendarcontract"],
    "media": ["content://media/", "mediastore"],
    "oaid": ["idprovider/identifierid", "vivo.vms.idprovider", "huawei.hms.ads", "xiaomi.ad.identifier"],
}
URI_NOISE = ["sensorsdata", "umeng", "bugly", "fileprovider"]
CONTENT_RESOLVER = "android.content.ContentResolver"
MUST_RECORD_METHODS = ["getDeviceId", "getImei", "getSimSerialNumber", "getSubscriberId", "getScanResults", "open",
                       "takePicture", "startRecording", "getCurrentLocation"]
SYSTEM_PREFIXES = ["android.", "java.", "sun.", "org.apache."]
SYSTEM_CALLER = "系统/核心库"
OWN_CALLER = "应用自身业务"
DANGEROUS_PERMISSION_WORDS = ["LOCATION", "CAMERA", "CONTACTS", "STORAGE", "PHONE", "SMS"]

# fixed values: exploration noise
NOISE_PACKAGE_WORDS = ["inputmethod", "keyboard", "ime", "systemui", "launcher", "permissioncontroller",
                       "packageinstaller"]
ACTIVITY_PATTERN = r"([A-Za-z0-9._]+)/(\.?[A-Za-z0-9_$.\-]+)"

# --- policy text --------------------------------------------------------------------------------

# fixed values: HTML entities and blanks replaced in policy text
TEXT_REPLACEMENTS = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                     ("&#39;", "'"), ("\u00a0", " "), ("\u3000", " "), ("\t", " ")]
MAX_SENTENCE_CHARS = 450
# fixed values: a line that is only a number or a list marker
MARKER_LINE = (r"^([0-9]+(\.[0-9]+)*\.?|\([0-9]+\)|[0-9]+\)|\([a-zA-Z]\)|[a-zA-Z]\)|[0-9]+、|\.*[0-9][0-9.]*)$")
BARE_MARKER = r"^([0-9]+(\.[0-9]+)*\.?|\([0-9]+\)|[a-zA-Z]\))$"
ENTITY_PREFIX = r"^(您的|你的|您|的|部分|必要的|相关的|一些|某种)\s*"
ENTITY_SEPARATORS = r"[、，,;和\s]+"
SKIP_LABEL_IDS = [87]
SKIP_LABEL_WORDS = ["其他"]
ACTION_LABELS = ["collection", "sharing", "other"]
DEFAULT_CONTROLLER = "我们"

# --- data items ---------------------------------------------------------------------------------

# fixed values: field names to policy vocabulary
FIELD_ALIASES = {
    "imei": "IMEI", "imsi": "IMSI", "oaid": "OAID", "idfa": "IDFA", "idfv": "IDFV", "uuid": "UUID",
    "guid": "GUID", "android-id": "Android ID", "android_id": "Android ID", "deviceid": "device id",
    "wifi-mac": "MAC", "mac": "MAC", "ssid": "SSID", "bssid": "BSSID", "latitude": "GPS", "longitude": "GPS",
    "applist": "应用列表信息", "package": "包名信息", "appversion": "应用版本号", "osversion": "版本信息",
    "model": "型号", "realname": "真实姓名", "password": "密码",
}

# fixed values: standard name and the ways policies phrase it, in matching order
DECLARATION_VARIANTS = {
    "device id": ["设备ID", "设备标识", "设备标识符", "device id", "deviceid"],
    "IMEI": ["IMEI", "imei", "国际移动设备识别码", "设备IMEI"],
    "MEID": ["MEID", "meid", "移动设备识别码"],
    "Android ID": ["Android ID", "android id", "安卓ID", "AndroidID"],
    "SN": ["SN", "序列号", "设备序列号", "serial number"],
    "GUID": ["GUID", "guid", "全局唯一标识符"],
    "UUID": ["UUID", "uuid", "通用唯一标识符"],
    "型号": ["型号", "设备型号", "手机型号", "机型"],
    "系统语言": ["系统语言", "语言设置", "设备语言"],
    "平台": ["平台", "操作系统平台", "系统平台"],
    "厂商": ["厂商", "设备厂商", "手机厂商"],
    "品牌": ["品牌", "设备品牌", "手机品牌"],
    "版本信息": ["版本信息", "系统版本", "操作系统版本", "OS版本"],
    "屏幕分辨率": ["屏幕分辨率", "分辨率", "屏幕尺寸"],
    "蓝牙信息": ["蓝牙信息", "蓝牙", "蓝牙设备"],
    "蓝牙MAC": ["蓝牙MAC", "蓝牙地址", "蓝牙MAC地址"],
    "IP": ["IP", "IP地址", "ip地址", "网络IP", "设备IP"],
    "MAC": ["MAC", "MAC地址", "mac地址", "网卡地址", "物理地址"],
    "wifi": ["wifi", "WiFi", "WIFI", "无线网络", "WiFi信息"],
    "SSID": ["SSID", "ssid", "WiFi名称", "网络名称"],
    "BSSID": ["BSSID", "bssid", "WiFi BSSID"],
    "网络状态信息": ["网络状态", "网络连接状态", "联网状态"],
    "网络类型": ["网络类型", "网络制式", "联网方式"],
    "运营商信息": ["运营商", "运营商信息", "网络运营商"],
    "GPS": ["GPS", "gps", "GPS定位", "GPS信息"],
    "经纬度": ["经纬度", "经度", "纬度", "地理坐标", "坐标"],
    "基站信息": ["基站", "基站信息", "基站定位"],
    "地区": ["地区", "区域", "所在地区"],
    "城市": ["城市", "所在城市"],
    "姓名": ["姓名", "真实姓名", "用户姓名", "名字"],
    "身份证号": ["身份证", "身份证号", "身份证号码", "证件号"],
    "面部特征": ["面部", "人脸", "面部特征", "人脸信息", "面部识别"],
    "指纹": ["指纹", "指纹信息", "指纹识别"],
    "声纹": ["声纹", "声纹信息", "声音特征"],
    "手机号": ["手机号", "手机号码", "电话号码", "联系电话", "手机"],
    "邮箱": ["邮箱", "电子邮箱", "邮件地址", "email"],
    "通讯录": ["通讯录", "联系人", "联系人信息", "通讯录信息"],
    "UserId": ["用户ID", "userid", "用户标识", "账号ID"],
    "账号密码": ["密码", "账号密码", "登录密码", "口令"],
    "登录凭证": ["登录凭证", "token", "令牌", "会话", "session"],
    "通话记录": ["通话记录", "通话历史", "电话记录"],
    "短信记录": ["短信", "短信记录", "短信内容"],
    "IMSI": ["IMSI", "imsi", "国际移动用户识别码"],
    "ICCID": ["ICCID", "iccid", "SIM卡序列号", "SIM卡ID"],
    "OAID": ["OAID", "oaid", "匿名设备标识符", "开放匿名标识"],
    "IDFA": ["IDFA", "idfa", "广告标识符"],
    "GAID": ["GAID", "gaid", "Google广告ID"],
    "应用列表信息": ["应用列表", "已安装应用", "安装列表", "软件列表"],
    "应用版本号": ["应用版本", "APP版本", "版本号"],
    "包名信息": ["包名", "应用包名", "bundle id"],
    "剪切板": ["剪贴板", "剪切板", "复制内容", "粘贴板"],
}

# fixed values: broad terms that name whole taxonomy categories
# fixed values: further broad terms and the items they hide
VAGUE_TERMS = {
    "设备标识": ["device id", "IMEI", "MEID", "Android ID", "SN", "GUID", "UUID"],
    "设备标识符": ["device id", "IMEI", "MEID", "Android ID", "SN", "GUID", "UUID", "OAID"],
    "唯一标识符": ["device id", "IMEI", "Android ID", "GUID", "UUID", "OAID"],
    "地理位置": ["GPS", "经纬度", "基站位置信息", "地区", "城市"],
    "定位信息": ["GPS", "经纬度", "基站位置信息", "WLAN接入点"],
    "账户信息": ["UserId", "账号密码", "登录凭证"],
    "身份信息": ["姓名", "身份证号", "手机号"],
    "生物特征": ["面部特征", "指纹", "声纹"],
    "联系方式": ["手机号", "邮箱", "通讯录"],
}
# fixed values: other names of a category
BROAD_ALIASES = {
    "设备信息": ["设备标识", "设备标识符", "唯一标识符"],
    "位置信息": ["地理位置", "定位信息"],
    "个人信息": ["身份信息", "账户信息"],
}

# fixed values: severity of an undeclared item
HIGH_SEVERITY_ITEMS = ["身份证号", "面部特征", "指纹", "声纹", "银行卡", "密码", "账号密码", "通话记录", "短信记录",
                       "通讯录", "IMEI", "IMSI", "手机号", "姓名", "真实姓名"]
HIGH_SEVERITY_CATEGORIES = ["个人信息", "SIM卡信息"]
LOW_SEVERITY_ITEMS = ["应用版本号", "版本信息", "系统语言", "屏幕分辨率", "屏幕方向", "时区", "平台"]
LOW_SEVERITY_CATEGORIES = ["应用信息", "设备参数"]

# fixed values: violation types
APP_UNDECLARED = "APP自身违规收集未声明数据"
SDK_UNDECLARED = "SDK违规收集未声明数据"
VAGUE_DECLARATION = "模糊声明"

# fixed values: item classification
UNCLASSIFIED_ITEM = "未分类数据"
INVALID_ITEM_TERMS = ["n/a", "na", "无", "暂无", "不适用"]
GENERIC_ITEM_TERMS = ["个人信息", "您的信息", "该部分隐私数据", "所指定的个人信息", "隐私数据", "信息"]
ITEM_SYNONYMS = {
    "设备平台": "平台", "设备厂商": "厂商", "设备品牌": "品牌", "设备型号": "型号", "设备识别码": "device id",
    "设备序列号": "sn", "交易金额信息": "金额", "支付订单号": "订单号", "通信/通话记录": "通话记录",
    "联系方式": "联系人", "人脸照片": "面部特征", "人脸照片数据": "面部特征", "特征码数据": "面部特征",
    "声码识别": "声纹", "cookie": "浏览记录", "名为cookie的小数据文件": "浏览记录", "账户信息": "其他账号",
    "昵称": "其他账号", "头像": "图片信息", "订单信息": "订单号", "交易": "消费记录", "支付": "消费记录",
    "消费记录": "消费记录", "物流信息": "访问日期",
}
ITEM_STOPWORDS = ["该部分", "所指定", "个人", "您的", "隐私", "数据", "信息", "相关", "上述", "以上", "例如", "等",
                  "内容"]
ITEM_MATCH_SCORE = 85
ACTION_NAMES = {"collection": "收集", "sharing": "共享", "other": "其他"}

# --- compliance rules ---------------------------------------------------------------------------

# fixed values: rule names
RULE_NAMES = {
    "R1": "结构完整性缺失", "R2": "信息来源缺失", "R3": "存储生命周期缺失", "R4": "用户核心权利缺失",
    "R5": "政策更新机制缺失", "R6": "未经同意收集", "R7": "违规扩散", "R8": "模糊披露",
}
STATUS_VIOLATED, STATUS_OK, STATUS_UNKNOWN = "违规", "合规", "证据不足"
# fixed values: core modules and the labels that stand in for them
MODULE_PROXIES = {
    "A1": ["处理者", "身份"],
    "C1": ["个人信息收集与使用", "处理的个人信息类别", "个人信息来源", "处理目的"],
    "D1": ["个人信息分享", "合并分立"],
    "E1": ["数据主体权利", "获取权", "修改权", "删除权", "撤回同意权", "政策更新", "数据泄露通知"],
    "F1": ["响应时间", "拒绝情形", "投诉"],
    "I1": ["数据存储细节", "存储时长", "存储地点"],
    "J1": ["个人信息安全"],
}
STORAGE_PROXIES = ["数据存储细节", "存储时长", "存储地点", "处理方法"]
RIGHTS_PROXIES = ["数据主体权利", "获取权", "修改权", "删除权", "撤回同意权", "知情权", "拒绝权", "自动决策权"]
CORE_RIGHTS = {"E6": "获取权", "E7": "修改权", "E8": "删除权", "E11": "撤回同意权"}
STORAGE_PARTS = {"I2": "存储时长", "I3": "存储地点"}
LABEL_ALIASES = {
    "A1": ["处理者"], "C1": ["个人信息收集与使用"], "C2": ["处理的个人信息类别"], "C4": ["个人信息来源"],
    "D1": ["个人信息分享"], "D2": ["接收方"], "E1": ["数据主体权利"], "E3": ["政策更新"],
    "E6": ["获取权", "访问权"], "E7": ["修改权", "更正权"], "E8": ["删除权"], "E11": ["撤回同意权", "注销权"],
    "F1": ["投诉"], "I1": ["数据存储细节"], "I2": ["存储时长"], "I3": ["存储地点"], "J1": ["个人信息安全"],
}
PRE_CONSENT_PHASES = ["pre_consent", "before_consent", "before_agree"]
# fixed values: further phase of a record
START_PHASES = ["startup"]
READINESS_STEPS = {"policy": "隐私政策分析", "static": "应用静态分析", "dynamic": "动态沙箱分析"}

# fixed values: clause labels in model order (dotted id, name)
CLAUSE_LABELS = [
    ("1", "处理者"), ("1.1", "身份"), ("1.2", "联系方式"), ("1.2.1", "电话号码"), ("1.2.2", "电子邮箱"),
    ("1.2.3", "法律地址"), ("2", "处理代表"), ("2.1", "身份"), ("2.2", "联系方式"), ("2.2.1", "电话号码"),
    ("2.2.2", "电子邮箱"), ("2.2.3", "法律地址"), ("3", "个人信息保护负责人"), ("3.1", "身份"),
    ("3.2", "联系方式"), ("3.2.1", "电话号码"), ("3.2.2", "电子邮箱"), ("3.2.3", "法律地址"),
    ("4", "个人信息收集与使用"), ("4.1", "处理的个人信息类别"), ("4.1.1", "常规个人信息"),
    ("4.1.2", "敏感个人信息"), ("4.2", "个人信息来源"), ("4.2.1", "直接主动"), ("4.2.2", "直接被动"),
    ("4.2.3", "间接"), ("4.3", "处理目的"), ("4.4", "处理方式"), ("4.5", "敏感信息处理"), ("4.6", "合法依据"),
    ("4.6.1", "个人同意"), ("4.6.2", "合同必需"), ("4.6.3", "法定义务"), ("4.6.4", "重大事件"),
    ("4.6.5", "公共利益"), ("4.6.6", "公开信息"), ("4.6.7", "其他法规要求"), ("5", "个人信息分享"),
    ("5.1", "接收方"), ("5.2", "情形"), ("5.2.1", "共同处理"), ("5.2.2", "委托处理"), ("5.2.3", "合并分立"),
    ("5.2.4", "个人单独同意"), ("6", "数据主体权利"), ("6.1", "知情权"), ("6.1.1", "政策更新"),
    ("6.1.2", "数据泄露通知"), ("6.1.3", "其他"), ("6.2", "获取权"), ("6.3", "修改权"), ("6.4", "删除权"),
    ("6.5", "限制权"), ("6.6", "拒绝权"), ("6.7", "转移权"), ("6.8", "自动决策权"), ("6.9", "撤回同意权"),
    ("6.10", "死者个人信息权益"), ("7", "投诉"), ("7.1", "响应时间"), ("7.2", "所需材料"), ("7.3", "拒绝情形"),
    ("8", "个人信息处理原则"), ("8.1", "明确合理目的"), ("8.2", "数据最小化"), ("9", "个人信息跨境传输"),
    ("9.1", "情形"), ("9.1.1", "安全评估"), ("9.1.2", "个人信息保护认证"), ("9.1.3", "合同"),
    ("9.1.4", "法律规定的其他条件"), ("9.2", "接收方"), ("9.2.1", "身份"), ("9.2.2", "联系方式"),
    ("9.3", "处理目的"), ("9.4", "处理方式"), ("9.5", "处理的个人信息类别"), ("9.6", "数据主体行使权利方式"),
    ("10", "数据存储细节"), ("10.1", "存储时长"), ("10.2", "存储地点"), ("10.3", "处理方法"),
    ("11", "个人信息安全"), ("12", "未成年人信息"), ("13", "非个保法要求"), ("13.1", "COOKIES"),
    ("13.2", "其他法律法规"), ("14", "其他"),
]
# fixed values: rule code of a clause (code, dotted id)
CLAUSE_CODES = [
    ("A1", "1"), ("A2", "1.1"), ("A3", "1.2"), ("B1", "3"), ("B2", "3.2"), ("C1", "4"), ("C2", "4.1"),
    ("C3", "4.1.2"), ("C4", "4.2"), ("C5", "4.2.1"), ("C6", "4.2.2"), ("C7", "4.2.3"), ("C8", "4.3"),
    ("C9", "4.4"), ("C10", "4.5"), ("C11", "4.6"), ("C12", "4.6.1"), ("C13", "4.6.2"), ("C14", "4.6.3"),
    ("C15", "4.6.4"), ("C16", "4.6.5"), ("C17", "4.6.6"), ("C18", "4.6.7"), ("D1", "5"), ("D2", "5.1"),
    ("D3", "5.2"), ("D4", "5.2.2"), ("D5", "5.2.3"), ("D6", "5.2.4"), ("E1", "6"), ("E2", "6.1"),
    ("E3", "6.1.1"), ("E4", "6.1.2"), ("E5", "6.1.3"), ("E6", "6.2"), ("E7", "6.3"), ("E8", "6.4"),
    ("E9", "6.6"), ("E10", "6.8"), ("E11", "6.9"), ("F1", "7"), ("F2", "7.1"), ("F3", "7.3"), ("G1", "8"),
    ("H1", "9"), ("H2", "9.1"), ("I1", "10"), ("I2", "10.1"), ("I3", "10.2"), ("I4", "10.3"), ("J1", "11"),
    ("K1", "12"), ("L1", "13"), ("L2", "13.1"),
]

# --- widgets ------------------------------------------------------------------------------------

# fixed values: widget class to class code, in suffix-matching order
WIDGET_CLASSES = [
    ("AdView", 1), ("HtmlBannerWebView", 1), ("AdContainer", 1), ("BottomTagGroupView", 3), ("BottomBar", 3),
    ("ButtonBar", 4), ("CardView", 5), ("CheckBox", 6), ("CheckedTextView", 18), ("DrawerLayout", 7),
    ("DatePicker", 8), ("ImageView", 9), ("ImageButton", 10), ("GlyphView", 10), ("AppCompactButton", 10),
    ("AppCompactImageButton", 10), ("ActionMenuItemView", 10), ("ActionMenuItemPresenter", 10),
    ("TextView", 11), ("EditText", 11), ("SearchBoxView", 11), ("AutoCompleteTextView", 11),
    ("AppCompatAutoCompleteTextView", 11), ("MultiAutoCompleteTextView", 11), ("ListView", 12),
    ("RecyclerView", 12), ("ListPopUpWindow", 12), ("tabItem", 12), ("GridView", 12), ("MapView", 13),
    ("SlidingTab", 14), ("NumberPicker", 15), ("Switch", 16), ("ViewPageIndicatorDots", 17),
    ("PageIndicator", 17), ("CircleIndicator", 17), ("PagerIndicator", 17), ("RadioButton", 18),
    ("SeekBar", 19), ("Button", 20), ("ToolBar", 21), ("TitleBar", 21), ("ActionBar", 21), ("VideoView", 22),
    ("WebView", 23),
]
INPUT_CLASSES = ["EditText", "AutoCompleteTextView", "AppCompatAutoCompleteTextView",
                 "MultiAutoCompleteTextView", "SearchView", "SearchAutoComplete"]
INPUT_WORDS = ["search", "query", "keyword", "filter", "input", "请输入", "搜索", "查询", "关键字", "筛选"]
BEST_INPUT_WORDS = ["search", "query", "input", "请输入", "搜索", "查询"]
CLOSE_WORDS = ["×", "close", "dismiss", "cancel", "done", "back", "return", "up", "关闭", "取消", "返回", "退出",
               "上一步", "nav", "navigate", "跳过"]
ENTRY_WORDS = ["tab", "btn", "button", "menu", "item", "entry"]
AGREE_WORDS = ["我同意", "同意并继续", "已阅读并同意", "同意", "允许并继续", "允许", "接受", "Agree", "Accept", "继续"]

# fixed values: exploration scores
API_WEIGHT, API_DECAY, WIDGET_SCORE = 10.0, 0.5, 0.5
NEW_STATE_SCORE, ESCAPE_SCORE, REVISIT_SCORE, STUCK_SCORE = 10.0, 12.0, -2.0, -15.0

# --- labels and thresholds ----------------------------------------------------------------------

# fixed values: threshold grid in percent, 10 … 85 step 5
THRESHOLD_PERCENTS = list(range(10, 90, 5))
DEFAULT_THRESHOLD = 0.5
EXAMPLE_HIGH, EXAMPLE_LOW = 0.91, 0.80
EXAMPLE_POSITIVES, EXAMPLE_NEGATIVES = 3, 1
