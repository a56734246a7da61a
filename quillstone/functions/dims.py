"""Reference tables: dealers, models, brands and keywords."""

# The master lists, brand tables and keyword lists that extraction and validation are defined by.

DEALERS = [
    "ABC Tractors",
    "Mahindra Tractors",
    "Sonalika Tractors",
    "John Deere",
    "Farmtrac",
    "Escorts",
    "Preet Tractors",
    "Punjab Tractors",
    "VST Tractors",
    "Captain Tractors",
    "Standard Tractors",
    "HMT Tractors",
    "International Tractors",
    "Kheti Tractors",
    "Agri King",
    "Tafe",
    "Indofarm",
    "Swaraj",
    "Kubota",
    "New Holland",
    "Eicher",
    "Massey Ferguson",
    "Force Motors",
    "Mahindra",
    "Sonalika",
    "Swraj",
    "Tafe",
    "Farmtrac",
    "John Deere",
    "New Holland",
    "Kubota",
    "Eicher",
    "Massey Ferguson",
    "Force Motors",
    "Tafe Tractors",
    "VST Tillers",
    "Greaves Cotton",
    "HMT",
    "Punjab",
    "Captain",
    "Standard",
    "Indo Farm",
    "Agri King",
    "Mahindra Tractor",
    "Sonalika Tractor",
    "Swraj Tractor",
    "Tafe Tractor",
    "Farmtrac Tractor",
    "John Deere Tractor",
    "New Holland Tractor",
    "Kubota Tractor",
    "Eicher Tractor",
    "Massey Ferguson Tractor",
    "Force Tractor",
    "VST Tractor",
    "Greaves Tractor",
    "HMT Tractor",
    "Punjab Tractor",
    "Captain Tractor",
    "Standard Tractor",
    "Indo Farm Tractor",
    "Agri King Tractor",
    "Mahindra And Mahindra",
    "M And M",
    "Sonalika International",
    "Punjab Tractor Corporation",
    "Escorts Kubota",
    "Laxmi Tractors",
    "Bharat Tractors",
    "Jaguar Tractors",
    "Shiv Tractors",
    "Ganpati Tractors",
    "Shri Ram Tractors",
    "Durga Tractors",
    "Krishna Tractors",
    "Om Tractors",
    "Sai Tractors",
    "Maruti Tractors",
    "Harsh Tractors",
    "Agrasen Tractors",
    "Bajaj Tractors",
    "Tractor Agency",
    "Tractor Company",
    "Tractor House",
    "Tractor Showroom",
    "Tractor Dealer",
    "Tractor Distributor",
    "Mitra Tractors",
    "Sankalp Tractors",
    "Samriddhi Tractors"
]

MODELS = [
    "Mahindra 575 DI",
    "Mahindra 265 DI",
    "Mahindra 415 DI",
    "Mahindra 475 DI",
    "Mahindra 555 DI",
    "Mahindra 595 DI",
    "Mahindra 265 DI XP Plus",
    "Mahindra 475 DI XP Plus",
    "Mahindra 575 DI XP Plus",
    "Mahindra 605 DI",
    "Mahindra 715 DI",
    "Mahindra 255 DI Power Plus",
    "Mahindra 275 DI XP Plus",
    "Mahindra 585 DI",
    "Mahindra ARJUN NOVO 605",
    "Mahindra YUVO",
    "Sonalika DI 35",
    "Sonalika DI 42",
    "Sonalika DI 50",
    "Sonalika DI 60",
    "Sonalika DI 750",
    "Sonalika GT 22",
    "Sonalika GT 26",
    "Sonalika RX 42",
    "Sonalika RX 50",
    "Swaraj 735",
    "Swaraj 744",
    "Swaraj 855",
    "Swaraj 825",
    "Swaraj 735 FE",
    "Swaraj 744 FE",
    "Swaraj 855 FE",
    "Swaraj 842",
    "Swaraj 724",
    "John Deere 5050",
    "John Deere 5105",
    "John Deere 5205",
    "John Deere 3028 EN",
    "John Deere 3036 EN",
    "John Deere 4049",
    "John Deere 5075",
    "Farmtrac 45",
    "Farmtrac 50",
    "Farmtrac 60",
    "Farmtrac 65",
    "Farmtrac 55",
    "Escorts 335",
    "Escorts 355",
    "Escorts 365",
    "Escorts 3120",
    "TAFE 245",
    "TAFE 345",
    "TAFE 440",
    "TAFE 5250",
    "TAFE 9500",
    "Kubota MU 4501",
    "Kubota MU 5501",
    "Kubota MU 4800",
    "Kubota L 4508",
    "Kubota L 3608",
    "New Holland 3037",
    "New Holland 3630",
    "New Holland 3032",
    "New Holland 4037",
    "New Holland 5500",
    "Eicher 380",
    "Eicher 480",
    "Eicher 500",
    "Eicher 560",
    "Eicher 6150",
    "Massey Ferguson 1035",
    "Massey Ferguson 1038",
    "Massey Ferguson 245",
    "Massey Ferguson 241",
    "Massey Ferguson 750"
]

DEALER_WORDS_EN = [
    'dealer', 'authorized', 'm/s', 'm/s ', 'tractors', 'motors', 'ltd', 'llp',
    'distributor', 'agency', 'sales', 'service', 'automobiles', 'vehicles',
    'company', 'corporation', 'enterprise', 'showroom', 'outlet', 'branch',
    'partner', 'associate', 'vendor', 'supplier', 'stockist'
]

DEALER_WORDS_HI = [
    'डीलर', 'विक्रेता', 'एम/एस', 'मोटर्स', 'लिमिटेड', 'एलएलपी', 'वितरक',
    'एजेंसी', 'बिक्री', 'सर्विस', 'ऑटोमोबाइल', 'वाहन', 'कंपनी', 'निगम',
    'उद्यम', 'शोरूम', 'आउटलेट', 'शाखा', 'भागीदार', 'सहयोगी', 'विक्रेता',
    'आपूर्तिकर्ता', 'स्टॉकिस्ट', 'ट्रैक्टर एजेंसी', 'ट्रैक्टर कंपनी',
    'ट्रैक्टर शोरूम', 'ट्रैक्टर डीलर', 'कृषि यंत्र', 'खेती उपकरण',
    'होलसेल', 'रिटेल', 'ट्रेडर', 'सेल्स एजेंट', 'सर्विस सेंटर'
]

DEALER_WORDS_HI_LATIN = [
    'dealer', 'vikreta', 'vikretA', 'm/s', 'motars', 'limited', 'llp', 'vitarak',
    'agenSee', 'bikree', 'sarvis', 'automoobil', 'vaahan', 'kampani', 'nigham',
    'udyam', 'sharum', 'aotlet', 'shakha', 'bhagidaar', 'sahyogi', 'aapurtikarta',
    'stokist', 'traktar agenSee', 'traktar kampani', 'traktar sharum',
    'traktar dealer', 'krishi yantr', 'kheti upkaran', 'holesel', 'ritel',
    'trader', 'sales agent', 'service center',
    'deelar', 'dealaar', 'daalar', 'daalaar', 'vkreta', 'vikrta', 'veekreta',
    'motar', 'motor', 'kampany', 'kampanee', 'shropm', 'showrowm', 'shoowroom',
    'agenCee', 'agensi', 'agenCy', 'sarvis', 'servis', 'serivice', 'serves',
    'vikas agent', 'vikas agency', 'traktar', 'tractar', 'trakter', 'traktar'
]

POWER_WORDS_EN = [
    'hp', 'horse', 'power', 'bh[Pp]', 'engine', 'capacity', 'tractor',
    'power output', 'engine power', 'rated power', 'maximum power',
    'bhp', 'metric hp', 'engine capacity', 'displacement'
]

POWER_WORDS_HI = [
    'हॉर्स पावर', 'हॉर्सपावर', 'एचपी', 'भाप', 'पावर', 'शक्ति', 'इंजन',
    'क्षमता', 'ट्रैक्टर', 'मोटर पावर', 'इंजन पावर', 'अधिकतम पावर',
    'रेटेड पावर', 'बीएचपी', 'मीट्रिक एचपी', 'इंजन क्षमता', 'विस्थापन',
    'बल', 'टॉर्क', 'ड्राइव पावर', 'पीटीओ', 'पावर टेक ऑफ'
]

POWER_WORDS_HI_LATIN = [
    'horsepower', 'horsepowar', 'horsepawar', 'hors power', 'hp', 'bhp',
    'power', 'powar', 'pawar', 'shkti', 'shakti', 'enjin', 'engine', 'enjine',
    'capacity', 'kapasiti', 'kmapcity', 'traktar', 'tractar', 'trakter',
    'motor power', 'motar power', 'max power', 'maximum power',
    'haurs power', 'hors powr', 'hars power', 'horspoar', 'horspwr',
    'AEchPee', 'aichpi', 'aych pi', 'eech pee', 'bhaap', 'bap', 'bhaap',
    'paavar', 'pawer', 'powr', 'shkti', 'shktY', 'enjen', 'enjyn',
    'kamal', 'kammlti', 'toraq', 'torque', 'traktr', 'traktar',
    'PTO', 'pto', 'ptoo', 'power takeoff', 'power take off'
]

COST_WORDS_EN = [
    'total', 'amount', 'price', 'cost', 'rs', '₹', 'rupees', 'grand total',
    'net amount', 'invoice value', 'deal value', 'transaction value',
    'payment', 'billing', 'quotation', 'estimate', 'ex-showroom', 'on-road'
]

COST_WORDS_HI = [
    'कुल', 'राशि', 'कीमत', 'मूल्य', 'भुगतान', 'टोटल', 'ग्रैंड टोटल',
    'शुद्ध राशि', 'इनवॉइस मूल्य', 'डील वैल्यू', 'ट्रांजैक्शन वैल्यू',
    'बिल', 'कोटेशन', 'अनुमान', 'एक्स-शोरूम', 'ऑन-रोड', 'दाम',
    'भाव', 'दर', 'वैल्यू', 'खर्चा', 'व्यय'
]

COST_WORDS_HI_LATIN = [
    'kul', 'raashi', 'raashee', 'kimat', 'keemat', 'muly', 'moolya',
    'bhugtan', 'bhugataan', 'total', 'grand total', 'net amount',
    'shudh raashi', 'shudh rashi', 'invoice value', 'invois mulya',
    'deal value', 'del valyu', 'transaction value', 'tranzakshan valyu',
    'bill', 'bil', 'quotation', 'kwoteshan', 'estimate', 'eshtimt',
    'ex showroom', 'exsharwm', 'on road', 'onrod', 'on-road',
    'dam', 'daam', 'dham', 'bhaav', 'bhaav', 'dar', 'daar',
    'kharcha', 'kharchya', 'vyay', 'veay', 'lagat', 'lgaat',
    'rupaiya', 'rupee', 'rupiya', 'rs', 'rpees', 'rs.',
    'mulya', 'mulya', 'moolya', 'qeemat', 'qemat',
    'jma', 'jmaa', ' jama', 'jmaa'
]

COMPANY_WORDS_EN = [
    'ltd', 'llp', 'pvt', 'private', 'company', 'corp', 'inc',
    'motors', 'tractors', 'automobiles', 'agency', 'dealers',
    'limited', 'corporation', 'holdings', 'group', 'enterprises'
]

COMPANY_WORDS_HI = [
    'लिमिटेड', 'प्राइवेट', 'कंपनी', 'कारपोरेशन', 'होल्डिंग्स',
    'ग्रुप', 'एंटरप्राइजेज', 'निगम', 'संस्था', 'व्यापार'
]

COMPANY_WORDS_HI_LATIN = [
    'limited', 'limtd', 'limeted', 'pvt', 'private', 'privet',
    'company', 'kampani', 'kampany', 'kampanee', 'corpration',
    'corporeshon', 'holdings', 'holdngs', 'group', 'grwp',
    'enterprises', 'enterprizes', 'nigham', 'nigam', 'sanstha',
    'vyapar', 'vyapaar', 'business', 'bisnes'
]

BRAND_POWER = {
    'mahindra': (20, 75),
    'sonalika': (30, 60),
    'swaraj': (25, 60),
    'john deere': (25, 75),
    'john': (25, 75),
    'farmtrac': (25, 50),
    'escorts': (25, 55),
    'tafe': (25, 50),
    'new holland': (25, 75),
    'new': (25, 75),
    'kubota': (20, 60),
    'eicher': (20, 60),
    'massey ferguson': (20, 75),
    'massey': (20, 75),
    'force motors': (20, 50),
    'force': (20, 50),
}

BRAND_DEALERS = {
    'mahindra': 'Mahindra Tractors',
    'sonalika': 'Sonalika Tractors',
    'swaraj': 'Swaraj',
    'john deere': 'John Deere',
    'john': 'John Deere',
    'farmtrac': 'Farmtrac',
    'escorts': 'Escorts',
    'tafe': 'Tafe',
    'new holland': 'New Holland',
    'new': 'New Holland',
    'kubota': 'Kubota',
    'eicher': 'Eicher',
    'massey ferguson': 'Massey Ferguson',
    'massey': 'Massey Ferguson',
    'force motors': 'Force Motors',
    'force': 'Force Motors',
}

DEALER_WORDS = DEALER_WORDS_EN + DEALER_WORDS_HI + DEALER_WORDS_HI_LATIN
POWER_WORDS = POWER_WORDS_EN + POWER_WORDS_HI + POWER_WORDS_HI_LATIN
COST_WORDS = COST_WORDS_EN + COST_WORDS_HI + COST_WORDS_HI_LATIN
COMPANY_WORDS = COMPANY_WORDS_EN + COMPANY_WORDS_HI + COMPANY_WORDS_HI_LATIN
# The brands that the check inside extraction knows, in order; their ranges and dealers are those above.
CHECKED_BRANDS = ['mahindra', 'sonalika', 'swaraj', 'john deere', 'farmtrac', 'escorts', 'tafe', 'new holland', 'kubota', 'eicher']
