"""Lookup tables.

Fixed values: label vocabularies and code tables that conversions must share
for their results to agree, in their natural order.
"""

NB15_TO_KDD_LABELS = {
    "Normal": "normal",
    "Generic": "neptune",
    "Exploits": "satan",
    "Fuzzers": "ipsweep",
    "DoS": "smurf",
    "Reconnaissance": "nmap",
    "Analysis": "portsweep",
    "Backdoor": "back",
    "Shellcode": "buffer_overflow",
    "Worms": "warezclient",
}

MQTT_TO_KDD_LABELS = {
    "legitimate": "normal",
    "dos": "smurf",
    "slowite": "neptune",
    "flood": "back",
    "bruteforce": "guess_passwd",
    "malformed": "buffer_overflow",
}

UKM_TO_KDD_LABELS = {
    "Normal": "normal",
    "UDP data flood": "neptune",
    "ARP poisining": "smurf",
    "TCP flood": "back",
    "BeEF HTTP exploits": "warezclient",
    "Mass HTTP requests": "teardrop",
    "Metasploit exploits": "satan",
    "Port scanning": "nmap",
}

CIC_TO_KDD_LABELS = {
    "BENIGN": "normal",
    "DDoS": "neptune",
    "PortScan": "ipsweep",
    "Bot": "satan",
    "Infiltration": "buffer_overflow",
    "Web Attack – Brute Force": "guess_passwd",
    "Web Attack – XSS": "xss",
    "Web Attack – Sql Injection": "sqlattack",
}

KDD_TO_CIC_LABELS = {
    "normal": "BENIGN",
    "neptune": "DoS",
    "smurf": "DDoS",
    "back": "DoS",
    "teardrop": "DoS",
    "pod": "DoS",
    "land": "DoS",
    "satan": "PortScan",
    "ipsweep": "PortScan",
    "portsweep": "PortScan",
    "nmap": "PortScan",
}

# Matched in order: the first key contained in the label decides.
CIC_LABEL_PARTS_SHORT = (
    ("BENIGN", "Normal"),
    ("DoS", "DoS"),
    ("PortScan", "Reconnaissance"),
    ("DDoS", "DoS"),
    ("Bot", "Backdoor"),
    ("Brute Force", "BruteForce"),
    ("Web Attack", "Web"),
)
CIC_LABEL_PARTS = CIC_LABEL_PARTS_SHORT + (
    ("Infiltration", "Exploits"),
    ("Web Attack – Brute Force", "BruteForce"),
    ("Web Attack – XSS", "Web"),
    ("Web Attack – Sql Injection", "Web"),
    ("Heartbleed", "Exploits"),
)

PROTOCOL_CODES = {1: "icmp", 6: "tcp", 17: "udp", 256: "other"}
CONNECTION_CODES = {0: "SF", 1: "S0", 2: "S1", 3: "S2", 4: "S3", 5: "OTH"}

KDD_FAMILIES = {
    "normal": ("normal",),
    "dos": ("neptune", "smurf", "back", "teardrop", "pod", "land", "apache2", "processtable", "mailbomb"),
    "probe": ("satan", "ipsweep", "portsweep", "mscan", "nmap", "saint"),
    "r2l": (
        "guess_passwd", "ftp_write", "imap", "phf", "multihop", "warezclient", "warezmaster",
        "snmpguess", "snmpgetattack", "httptunnel", "ps", "sendmail", "xlock", "xterm",
        "named", "perl", "xsnoop",
    ),
    "u2r": ("buffer_overflow", "loadmodule", "rootkit"),
    "spy": ("spy",),
}

NB15_FAMILIES = {
    "normal": ("Normal",),
    "denial of service": ("DoS",),
    "reconnaissance": ("Reconnaissance",),
    "exploit": ("Exploits",),
    "fuzzing": ("Fuzzers",),
    "analysis": ("Analysis",),
    "backdoor": ("Backdoor",),
    "shellcode": ("Shellcode",),
    "worm": ("Worms",),
    "generic": ("Generic",),
}

MQTT_QUOTAS = {
    "legitimate": 330204,
    "flood": 58356,
    "slowite": 44864,
    "malformed": 35295,
    "dos": 16455,
    "bruteforce": 9960,
}


def family_pairs(families: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """``attack -> family`` from ``family -> attacks``."""
    return {attack: family for family, attacks in families.items() for attack in attacks}
