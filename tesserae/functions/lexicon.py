"""The word lists that search classification must share with existing reports."""

BRANDS = {
    "Tata": ["tata", "tata ace", "tata intra", "tata winger", "tata led"],
    "Maruti Suzuki": ["maruti", "suzuki", "alto", "swift", "eeco", "ertiga", "baleno", "omni"],
    "Mahindra": ["mahindra", "bolero", "treo", "vero"],
    "Ashok Leyland": ["ashok leyland", "dost", "bada dost"],
    "Eicher": ["eicher"],
    "Bajaj": ["bajaj", "qute", "maxima", "bajaj re"],
    "Honda": ["honda", "civic", "dio", "unicorn"],
    "Yamaha": ["yamaha", "rx 100", "rx 135", "psr", "dgx"],
    "Royal Enfield": ["royal enfield", "hunter", "continental gt"],
    "Toyota": ["toyota", "qualis", "innova"],
    "Hyundai": ["hyundai", "xcent", "i20"],
    "Hero": ["hero", "hf deluxe", "splendor"],
    "TVS": ["tvs", "scooty", "pep plus"],
    "Piaggio": ["piaggio", "ape", "ape mini"],
    "Apple": ["apple", "iphone", "ipad"],
    "Canon": ["canon", "eos", "200d", "5d"],
    "Sony": ["sony", "a7", "playstation"],
    "DJI": ["dji", "mavic", "mini pro", "osmo"],
    "Benelli": ["benelli", "tnt"],
    "Kia": ["kia", "carens"],
    "Dell": ["dell"],
    "Bosch": ["bosch"],
    "Hitachi": ["hitachi"],
    "LG": ["lg"],
    "Samsung": ["samsung"],
    "Motorola": ["motorola", "edge"],
    "Fujifilm": ["fujifilm"],
    "Wipro": ["wipro"],
    "Bharat Benz": ["bharat benz"],
    "Force": ["force", "trax"],
}
LOCATIONS = [
    "chennai", "bangalore", "bengaluru", "hyderabad", "mumbai", "pune", "coimbatore", "madurai", "trichy", "thanjavur",
    "nagapattinam", "tirupur", "hosur", "salem", "karur", "erode", "theni", "kodaikanal", "velachery", "tambaram", "porur",
    "chromepet", "avadi", "omr", "saligramam", "vadapalani", "kelambakkam", "ayanavaram", "perungudi", "madhavaram", "srikakulam",
    "virudhunagar", "mayiladuthurai", "chengalpattu", "guntur", "rajahmundry", "krishnagiri", "dilsukhnagar", "nallakunta", "btm",
    "ejipura", "mira road", "mumbra", "andheri", "ville parle", "ooty", "port blair", "agra", "jammu", "delhi", "surat",
    "calicut", "kancheepuram", "pattukkottai", "puducherry", "west bengal", "maharashtra", "tamil nadu", "karnataka", "telangana",
    "andhra pradesh",
]
DURATIONS = {"Hourly": ["hourly", "per hour"], "Daily": ["daily", "per day", "one day"], "Weekly": ["weekly", "per week"], "Monthly": ["monthly", "per month"]}
TYPOS = [
    "blootooth", "draining school", "mahinra", "two weeler", "alting driver", "bero painter", "home shilding laber",
    "ac for renr", "cyclwhite", "ac frige", "tya ace", "ffemale", "fazer", "reng", "leesh", "krisnagiri", "i phone", "campanion",
    "puncher", "tution", "prizm", "fazed", "laber",
]
GIBBERISH = ["ddun", "vfl", "autolpg"]
SERVICES = [
    "hire", "service", "master", "driver", "electrician", "plumber", "cook", "therapist", "trainer", "tutor", "labour", "worker",
    "helper", "companion", "photographer", "instructor", "job", "work", "freelance", "nurse", "doctor",
]
BUSINESS = [
    "bulk", "commercial", "business", "company", "corporate", "industrial", "wholesale", "contract",
]
TRANSLITERATED = [
    "vandi", "thurai", "palayam", "nagar", "puram", "kudi", "kottai", "malai", "oor", "pattinam",
]
STOP_WORDS = [
    "for", "in", "on", "of", "to", "and", "the", "a", "an", "or", "is", "at", "by", "from", "with", "per", "if", "any", "all",
    "i", "me", "my", "we", "our", "you", "your", "it", "its", "am", "be", "no", "not", "do", "does", "did", "has", "have", "had",
    "will", "can", "could", "should", "would", "may", "shall", "here", "there", "one", "this", "that", "these", "those", "-", "&",
]
#: Found anywhere in the text, parts of words too; the first that fits counts.
PROFESSIONS = {
    "Acting Driver": ["acting driver", "driver"],
    "Massage Therapist": ["massage", "therapist", "massager"],
    "Cook / Parotta Master": ["cook", "parotta", "chef", "caterer", "biriyani"],
    "Electrician": ["electrician", "electrical"],
    "Photographer": ["photographer", "photography"],
    "Trainer / Instructor": ["trainer", "instructor", "training"],
    "Tutor / Teacher": ["tutor", "tuition", "teacher"],
    "Nurse / Medical": ["nurse", "doctor", "medical", "psychiatrist"],
    "Carpenter / Painter": ["carpenter", "painter", "mason"],
    "Plumber": ["plumber"],
    "Helper / Companion": ["helper", "companion"],
    "Writer / Editor": ["writer", "editor", "data entry", "typing"],
    "Cleaner / Climber": ["cleaner", "climber"],
    "Delivery / Logistics": ["delivery", "loading", "unloading"],
}
VEHICLES = [
    "car", "bike", "truck", "van", "bus", "auto", "scooter", "tata", "maruti", "mahindra", "eicher", "bajaj", "honda", "yamaha",
    "royal enfield", "hyundai", "tvs", "piaggio", "vehicle", "two wheeler", "three wheeler", "four wheeler", "lcv",
]
VEHICLE_KINDS = {
    "Cars": ["car", "alto", "swift", "ertiga", "innova", "civic", "xcent", "baleno", "eeco", "omni", "qualis"],
    "Bikes": ["bike", "two wheeler", "rx", "r15", "hunter", "unicorn", "hf deluxe", "tnt", "splendor"],
    "Trucks / LCV": ["truck", "lcv", "container", "open body", "eicher"],
    "Autos / 3-Wheeler": ["auto", "ape", "three wheeler", "qute"],
    "Vans / Buses": ["van", "bus", "winger", "seater"],
    "Scooters": ["scooter", "dio", "scooty", "pep"],
    "Mini Trucks / Pickup": ["tata ace", "ace", "dost", "intra", "bolero", "pickup"],
}
FOOD = [
    "cook", "chef", "parotta", "biriyani", "caterer", "food", "kitchen", "restaurant", "hotel", "bar", "stove", "cooking", "veg",
]
