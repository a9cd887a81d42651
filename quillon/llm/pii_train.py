"""Makes the weights of `pii` from generated, labelled text.

    python -m quillon.llm.pii_train FILLER.parquet OUT.npz [STEPS] [PROCESSES]

Items (names from syllables and common ones; numbers, mail and street addresses in many formats) stand in sentences put
together from word lists, or are put into sentences of a bounded sample (`MAX_FILLER` rows) of the `text` column of FILLER, which
is also the text without items, beside generated sentences on buildings, stains, specimens and technical numbers. Part of
the text is wrapped, hyphenated, misread and interrupted by page lines, as in scans.

About a sixth of the entries of every list (patterns, roles, verbs, labels, formats) is never used in training: `held_out`
makes text from those alone, for figures on unseen wording. Gradients are written out by hand, summed over processes; the
optimiser is Adam.
"""

from __future__ import annotations

import multiprocessing
import random
import re
import sys
import zlib

import numpy as np

from quillon.llm.pii import CHARS, KINDS, LABELS, encode

MAX_FILLER = 3000
HIDDEN, EMBED, LENGTH, BATCH = 48, 24, 128, 64

FIRST = "James Mary Robert Linda Michael Susan David Karen Ahmed Fatima Wei Mei Carlos Lucia Ingrid Lars Yuki Hiro Ana Pedro Olga Ivan Chloe Luc Aoife Sean Priti Ravi Zanele Thabo Emma Noah Greta Otto Nadia Omar Elin Anders Sofia Marco Jonathan Elizabeth William Margaret Patrick Hannah Samuel Rachel Daniel Ruth".split()
LAST = "Smith Johnson Brown Garcia Miller Davis Martinez Lopez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Walker Hall Young Allen King Wright Scott Green Baker Nguyen Patel Kowalski Novak Schmidt Weber Rossi Ferrari Dubois Laurent Larsen Berg Tanaka Sato Okafor Mensah Haddad Rahman Fletcher Hughes Bennett Foster Russell Griffin Hayes".split()
ONSET = "b c d f g h j k l m n p qu r s t v w y z br ch cr dr fl gr hj kr lh pr rh sh sk st sz th tr vr wr zh bl cl gl pl".split()
VOWEL = "a e i o u a e i o ae ai au ea ee ei ia ie io oa oo ou y".split()
CODA = "l n r s t d m x ck ld ll lm mb nd ng nt rd rk rn rt ss st th tz v ff sk".split()
PLACE_TAIL = "mere wood field stone moor haven ford ton ham dale bridge harrow sallow tarn fold port vale spring hollow wick by worth bury mouth side view burgh ville land minster cliff".split()
STREET = "Street St. St Road Rd Rd. Avenue Ave Ave. Lane Ln Drive Dr Court Ct Crescent Terrace Way Close Place Blvd Boulevard Square Rise Hill Row Parkway Gardens Grove Walk Circle Mews Quay Path Pike Trail".split()
ABROAD = "straße strasse weg gasse platz allee".split()
MONTHS = "January February March April May June July August September October November December".split()

PATIENTS = "Patient|Pt|Client|Resident|Inpatient|Outpatient|Volunteer|Donor|Visitor|Witness|Relative|Closest relative|Emergency relative|Kin|Legal guardian|Proxy|Health proxy|Wife|Husband|Daughter|Son|Mother|Father|Brother|Sister|Neighbour|Friend|Carer|Care partner|Student|Trainee|Bearer|Interpreter|Driver".split("|")
LABELLED = "labelled|marked|tagged|identified as belonging to|in the name of|bearing the name|together with|along with|in agreement with|jointly with|shown again to|side by side with|on request of|at the wish of|belonging to|seconded by|assisted by|in consultation with|delivered for|signed over to|addressed to|sealed by".split("|")
THINGS = "scanner|reagent|kit|antibody|buffer|cassette|slide tray|printer|freezer|probe|wax|coverslip batch|dye|instrument|form|microtome|device|pump|catheter|stent|port|implant|panel|plate|order|shipment|analyzer|control tissue|filter|software|bottle|request|camera".split("|")
THING_NO = "lot number|batch number|serial number|catalogue number|order number|code|reference|model number|version|barcode|part number|tracking number|item number|product code|label|id|expiry code|inventory number|asset tag|revision|control number|stock number".split("|")
ROLES = "surgeon|physician|pathologist|oncologist|radiologist|registrar|resident|fellow|consultant|specialist|practitioner|secretary|pharmacist|therapist|counsellor|chaplain|technician|technologist|coordinator|clerk|midwife|doctor|nurse|dietician|anaesthetist|cardiologist|pulmonologist|clinician|navigator|social worker|case manager|phlebotomist|paramedic".split("|")
KIN = "mother|father|sister|brother|aunt|uncle|niece|nephew|cousin|husband|partner|spouse|stepson|granddaughter|grandson|neighbour|friend|guardian|carer|caregiver|landlady|fiancé|widow|twin|roommate|employer|daughter|son|wife".split("|")
KIND_OF = "attending|on-call|senior|junior|covering|treating|supervising|duty|new|former|local|visiting|chief|family|primary|second|younger|elder|older|late|adopted|own|other|nearest".split("|")
DONE_BY = "examined|interviewed|operated on|admitted|discharged|counselled|countersigned|transcribed|typed|authorised|electronically signed|prepared|grossed|screened|escorted|accompanied|driven home|consulted|seen|approved|edited|released|drafted|checked|entered|reviewed|referred|collected|handed over|booked|assessed|scheduled|annotated|received|photographed|written|read|explained|witnessed|requested|amended".split("|")
SPOKE = "spoke with|met|talked to|conferred with|heard from|wrote to|called|e-mailed|asked|informed|reached|left word for|thanked|consulted|visited|telephoned|saw|notified|updated|reassured|advised|agreed with|waited for|paged".split("|")
ABOUT = "about the scan|regarding the margins|on the ward|this morning|yesterday evening|before surgery|after the meeting|concerning treatment|twice|at the bedside|for consent|to arrange transport|and explained the plan|as planned|again|who agreed|face to face|during the round|over the weekend|at the door|by video|with an interpreter|at the front desk|last week|without delay".split("|")
NAME_VERB = "attended|asks|states|denies|drove|signed|reported|returned|declined|agreed|prefers|wishes|will call|visited|noticed|remembers|smoked|works|lives alone|was told|was admitted|was sent on|has improved|is anxious|had no pain|took part|collected the letter|came with family|stopped smoking|presented with cough|tolerated the procedure".split("|")
NAME_FIELD = "Attending|Surgeon|Author|Provider|Ordering MD|Submitted by|Emergency contact|Guardian|Spouse|Transcriptionist|Patient|Patient name|Name|Pt|Re|To|From|Attn|Operator|Assistant|Reviewer|Full name|Surname|Physician|Seen by|Clinician|Doctor|Witness|Signature|Contact|Resident|Reader|Electronically signed|Reported by|Checked by|Responsible consultant|Requested by|Dictated|Primary care|cc|Copies|Case discussed with|Clinical lead|Escort|Relative".split("|")
TITLES = "Dr. |Dr |Mr. |Mr |Mrs. |Mrs |Ms. |Ms |Miss |Prof. |Professor |Doctor |Nurse |Sister |Sir ".split("|")
DEGREES = ", MD|, M.D.|, PhD|, RN|, FRCPath|, DO|, MBBS| (attending)| (resident)|, MD, PhD|, consultant| (wife)| (son)".split("|")
LINKS = "by |with |to |for |from |, |per |via |(|and |as |told ".split("|")
PHONE_CUE = "Call|Ring|Dial|Phone|Tel|Tel.|Telephone|Mobile|Cell|Fax|Pager|Office|Home|Work|Direct line|Contact number|Landline|Extension line|Hotline|Switchboard|Reach us on|Text|Emergency number|Day phone|Evening phone|Desk|Clinic line|Phone no.|Voicemail|Reachable at|Messages to|Number|New number|Try the number|Gave the number|Best number is|Number on file|Another number is|Same number|Back line|WhatsApp|Bleep".split("|")
MAIL_CUE = "E-mail|Email|Mail|Send to|Forward to|Write to|Contact|Address for replies|Reply to|Images to|Copies to|Questions to|Queries to|Inbox|Electronic mail|Account|cc|From|To|Reports go to|Reach|Inform|Message|Correspondence to".split("|")
HOME_CUE = "is living at|resides at|residing at|moved to|home is|stays at|now at|of|address|Address|Home|Residence|Street address|Billing address|Postal address|deliver to|Ship to|send post to|discharged to|house at|flat at|found at|picked up from|visited at|returned to|Next delivery to|ambulance to|Old address|mail goes to|care home at|registered at".split("|")
SUBJECTS = "The patient|She|He|The family|Our team|The ward|The office|The clinic|They|We|The laboratory|The carer|This person|The household|One relative|The receptionist|The courier|A friend".split("|")
ID_CUE = "MRN|Medical record|Medical record number|Record no.|Chart|Chart no.|Chart number|Hospital number|Hospital no.|Patient ID|Patient no.|Pt ID|SSN|Social security|Social security number|NHS|NHS no.|National ID|National insurance|Insurance|Insurance ID|Insurance no.|Policy|Policy no.|Member|Member ID|Member no.|Passport|Passport no.|Passport number|Driver's licence|Driving licence|License no.|Health card|Health card no.|Beneficiary|Subscriber ID|Medicare|Medicaid ID|Tax ID|Identity card|ID card|Identification|Identity document|Permit|Permit no.|Certificate of insurance|Claim|Claim no.|Enrollee|Group policy|Plan ID|Coverage no.|Patient record|Patient file|File no.|Case file of the patient|Admission no.|Encounter|Visit no.|Registry ID|Residence permit|Military ID|Pension no.|Citizen number|Birth number|Benefit card|ID|ID no.|Account no.|Plan member|Identity number|Unit record|Registration no.|Personal number|Resident permit|Voter ID|Hosp. no.|URN|UMRN|Hospital ID|Wrist band".split("|")
ID_NEAR = "checked against|recorded as|billed under|filed under|confirmed with|matched to|enrolled with|identified with|linked to|registered as|shown on the wristband as|stored with|found under|given as|quoted as|printed with|claims went to|presented|proved identity with|booked under|merged with".split("|")
DECOY_CUE = "Specimen|Accession|Accession no.|Block|Lot|Lot no.|Batch|Slide|Cassette|Case|Case no.|Catalogue no.|Cat. no.|Code|Clone|Serial no.|Kit|Protocol|Trial|Probe|Antibody|Morphology code|Topography code|ICD-10|ICD-O|SNOMED|CPT|Reagent|Container|Section|Tube|Plate|Scanner|Stain|Barcode of the slide|Grant|Ref. report|Previous report|Archive box|Image series|Model|Version|DOI|PMID|Assay|Sample|Fixative batch|Stainer run|Instrument".split("|")
DECOY_NEAR = "was recut|expires soon|was submitted|was stored|is on file|was compared|went into use|was assigned|was unsealed|has been scanned|was reviewed|was retrieved|failed quality control|was repeated|is attached|was logged|came from the archive|was decalcified|shows tumor|was exhausted|is pending".split("|")
PLACES = "Hospital|Clinic|Institute|Wing|Pavilion|Building|Ward|Center|Centre|Tower|Laboratory|Medical Center|University|Hall|Unit|Campus|Library|Foundation|Trust|Infirmary|College|Department|Hospice|Pharmacy|School of Medicine|Cancer Center|Archive|Theatre".split("|")
AT_PLACE = "Transferred to|Scanned at|Slides from|Seen at|The biopsy was done in|Held by|Sent to|Surgery took place at|Blocks are kept in|Outside review at|Admitted to|Referred from|Second opinion from|Located in|Trained at|The board met at|Stored in|Examined at".split("|")
STAIN = "stain|cells|bodies|disease|syndrome|score|test|grade|type|region|classification|lymphoma|tumor|method|medium|criteria|reaction|staining|index|sign|ligament|method stain|technique|curve|nodes|tract|granules|capsule|duct|triangle|pouch|scale|stage|formula|procedure|catheter|needle|anomaly|fixative".split("|")
STAIN_TAIL = "was negative|could not be shown|was ruled out|is positive|were present|shows no organisms|was repeated|remains low|was applied|are absent|fits best|is preserved|was considered|is pending|were counted|is uninvolved|was normal|were noted focally".split("|")
UNITS = "mm|cm|mg|ml|percent|years|days|weeks|cycles|Gy|kg|mmHg|litres|nodes|slides|pm|hours|mg/m2|cores|sections|high power fields|packs|months|beats".split("|")
MEASURED = "Measures|Arrived on|Time of collection|Weight|Dose|Reported at|Ratio|Dated|Page|Floor|Room|Level|Cycle|Grade|Bay|Channel|Score|Count|Volume|Level of Ki-67|Collected|Printed|Range|Taken on|Visit on".split("|")
HEAD = "PATHOLOGY CONSULTATION CYTOLOGY HISTOLOGY RADIOLOGY ONCOLOGY SURGICAL DIAGNOSIS REPORT HISTORY SPECIMEN FINAL OPERATIVE NOTE DESCRIPTION COMMENT FINDINGS IMPRESSION SUMMARY RESULTS ADDENDUM PROCEDURE LABORATORY COPY CONSULT SECTION DEPARTMENT SERVICE CONFIDENTIAL PRELIMINARY AMENDED TUMOR MARGINS STAGING ANCILLARY STUDIES INTAKE DISCHARGE LETTER MOLECULAR CLINICAL MICROSCOPY GROSS IMAGING PLAN ASSESSMENT TREATMENT REVIEW THORACIC PULMONARY CONTINUED".split()
PAGE = ["Page {d}", "- {d} -", "[{d}]", "Page {d} of {d}", "p. {d}/{d}", "{d}", "Pg {d} of {d}", "Sheet {d}", "{d} / {d}"]

R = random.Random(7)
#: Whether lists give their training entries or those held out.
UNSEEN = False


def pick(entries):
    """One entry: of those used in training, or of the sixth or so that is held out (a list of few entries has none)."""
    own = [e for e in entries if (zlib.crc32(e.encode()) % 6 == 2) == UNSEEN] if len(entries) > 10 else entries
    return R.choice(own or entries)


def digits(n: int) -> str:
    return "".join(R.choice("0123456789") for _ in range(n))


def shaped(shape: str) -> str:
    """# is a digit, A a capital letter; everything else stands for itself."""
    return re.sub("[#A]", lambda m: digits(1) if m[0] == "#" else R.choice("ABCDEFGHJKLMNPQRSTUVWXYZ"), shape)


def syllables(n: int) -> str:
    return "".join(R.choice(ONSET) + R.choice(VOWEL) + (R.choice(CODA) if R.random() < 0.5 else "") for _ in range(n)).capitalize()


def first_name() -> str:
    return pick(FIRST) if R.random() < 0.4 else syllables(R.choice((1, 2, 2, 3)))


def last_name() -> str:
    x = R.random()
    if x < 0.3:
        return pick(LAST)
    if x < 0.38:
        return f"{syllables(2)}-{syllables(R.choice((1, 2)))}"
    if x < 0.44:
        return R.choice(("O'", "Mc", "D'", "Mac")) + syllables(2)
    if x < 0.47:
        return R.choice(("van ", "de ", "von ", "al-", "van der ", "da ")) + syllables(2)
    if x < 0.52:
        return pick(LAST) + R.choice("sn") if R.random() < 0.5 else pick(FIRST) + "son"
    return syllables(R.choice((2, 2, 3))) + (R.choice(PLACE_TAIL) if R.random() < 0.25 else "")


def name() -> str:
    f, m, s = first_name(), R.choice("ABCDEFGHJKLMNPRSTVW"), last_name()
    form = R.choices(("{f} {s}", "{f} {m}. {s}", "{m}. {s}", "{s}, {f}", "{s}, {f} {m}.", "{f} {m} {s}", "{m}.{n}. {s}", "{f}-{g} {s}", "{s} {m}."), (46, 11, 12, 14, 6, 3, 4, 3, 1))[0]
    out = form.format(f=f, m=m, s=s, g=first_name(), n=R.choice("ABCDEFGHJKLMNPRSTVW"))
    return out.upper() if R.random() < 0.13 else out


PHONES = "(###) ###-####|###-###-####|###.###.####|### ### ####|##########|+1 ### ### ####|+1-###-###-####|1-###-###-####|+1 (###) ###-####|07### ######|07### ### ###|+44 7### ######|+44 (0)#### ### ###|0#### ######|0### ### ####|+49 ## #######|+33 # ## ## ## ##|0## #### ####|(0##) #### ####|(0####) ######|+61 # #### ####|###/###-####|(###)###-####|+## ## ### ## ##|0##/#######|01### ######|## ## ## ## ##|1 ### ### ####|+353 ## ### ####|0## ### ## ##".split("|")
IDS = "######|#######|########|#########|##########|A######|A#######|A########|A#########|AA######|AA#######|###-##-####|### ## ####|### ### ####|###-###-##|######-####A|AA-###-####|AA###-####-####|##-######|AA ## ## ## A|####-####-####|###-######|A##-#####|A-#######|####-###-###|##-##-####|AAA#######|########A|## ### ###|AAA-######|#AA#-AA#-AA##|##.###.###|A###-####-####|000######|00#######".split("|")
DECOYS = "A#|A##|S##-#####|##-#####|####/#|#####|######|###-###|A##-####|AA#####|A#.#|##.#.####|##-AA-####|AA##-#####|####-##|######/##|#AA#|AA-###|####.##|A####|##A#####|########|S##-####|######-A|##:##|##/##/####|####-##-##|AAA#|#:###".split("|")


def phone() -> str:
    out = shaped(pick(PHONES))
    return out + shaped(R.choice([" x###", " ext. ###", " ext ####", ", ext. ####", " x ##", " extension ###"])) if R.random() < 0.18 else out


def domain() -> str:
    stem = R.choice([syllables(2), syllables(1) + pick(STAIN).split()[0], "mail." + syllables(2), syllables(2) + "-" + syllables(1), pick(PLACES).split()[0] + "." + syllables(2), syllables(3)]).lower()
    return stem + R.choice((".com", ".org", ".net", ".edu", ".co.uk", ".de", ".info", ".health", ".gov", ".io", ".care"))


def email() -> str:
    f, s = first_name().lower(), re.sub(r"[^a-z]", "", last_name().lower())
    user = R.choice([f"{f}.{s}", f"{f[0]}{s}", f"{s}-{digits(2)}", f"{s}_{f}", f"{f}{digits(2)}", f"{f}.{s}+{syllables(1).lower()}", f"{f}", f"{s}.{f}", f"{f}_{s}{digits(1)}", f"{s}{digits(4)}", f"{f[0]}.{s}", pick(ROLES).split()[0] + digits(1)])
    at, host = "@", domain()
    x = R.random()
    if x < 0.12:
        at, host = " (at) ", host.replace(".", " (dot) ")
    elif x < 0.18:
        at = R.choice((" [at] ", " (at) ", "(at)", " at "))
        host = host if at != " at " else host.replace(".", " dot ")
    out = user + at + host
    return out.upper() if R.random() < 0.12 else out


def id_number() -> str:
    return shaped(pick(IDS))


def place() -> str:
    p = syllables(R.choice((1, 2))) + R.choice(PLACE_TAIL) if R.random() < 0.6 else syllables(2)
    return R.choice(("Upper ", "Port ", "Cold ", "Old ", "North ", "St ", "Lower ", "East ", "New ", "Little ")) + p if R.random() < 0.25 else p


def address() -> str:
    road = R.choice([place(), f"{place()}'s {R.choice(('Rise', 'Gate', 'End'))}", f"Old {syllables(1)}", syllables(2), last_name(), pick(LAST), f"{R.randint(1, 30)}th", syllables(1) + " " + syllables(1)])
    if R.random() < 0.1:
        return f"{syllables(2)}{R.choice(ABROAD)} {R.randint(1, 99)}, {digits(5)} {place()}"
    unit = str(R.randint(1, 40))
    head = R.choice([f"{R.randint(1, 1999)}", f"{R.randint(1, 1999)}", f"{R.randint(1, 99)}", f"{R.randint(100, 1999)}-{unit}", f"{R.randint(1, 999)} {R.choice('NSEW')}.", f"{R.randint(1, 200)}{R.choice('ABab')}", f"Flat {unit}, {R.randint(1, 1900)}", f"Unit {unit}, {R.randint(1, 1900)}", f"Apt {unit}{R.choice('ABC')}, {R.randint(1, 900)}"])
    line = f"{head} {road} {pick(STREET)}"
    if R.random() < 0.25 and not head.startswith(("Flat", "Unit", "Apt")):
        line += R.choice([f", Unit {unit}", f", Apt {unit}B", f", Apt. {unit}", f" #{unit}", f", Suite {digits(3)}", f", Flat {unit}"])
    x = R.random()
    if x < 0.25:
        return line
    if x < 0.5:
        return f"{line}, {place()}"
    zipped = R.choice((shaped("#####"), shaped("#####"), shaped("AA# #AA"), shaped("A## #AA")))
    return f"{line}, {place()} {zipped}" if x < 0.75 else f"{line}, {place()}, {R.choice('ABCDEKLMNZ')}{R.choice('ACDEKLYZ')} {zipped}"


MAKE = {"name": name, "phone": phone, "email": email, "id_number": id_number, "address": address}


def _person() -> list:
    return [(pick(TITLES) if R.random() < 0.4 else "", None), (name(), 0), (pick(DEGREES) if R.random() < 0.15 else "", None)]


def _who() -> str:
    kind = pick(KIND_OF) + " " if R.random() < 0.5 else ""
    return R.choice(("the ", "her ", "his ", "our ", "a ", "my ", "their ", "")) + kind + (pick(ROLES) if R.random() < 0.55 else pick(KIN))


def _end() -> str:
    return R.choice((".", ".", ".", "", ";", " and " + pick(DONE_BY) + ".", ", " + pick(ABOUT) + ".", " " + pick(ABOUT) + "."))


def _cap(text: str) -> str:
    return text[:1].upper() + text[1:]


def name_parts() -> list:
    x = R.randrange(11)
    if x == 8:
        return [(pick(PATIENTS) + " ", None), *_person(), (R.choice((" was ", " has been ", " had been ", " is to be ", " is being ")) + pick(DONE_BY) + R.choice(("", " " + pick(ABOUT))) + ".", None)]
    if x == 9:
        what = R.choice((pick(DECOY_CUE), pick(SUBJECTS), "The " + pick(THINGS), "Slides", "All material"))
        return [(what + R.choice((" ", " was ", " were ", " arrived ")) + R.choice(("", pick(DONE_BY) + " ")) + pick(LABELLED) + " ", None), *_person(), (_end(), None)]
    if x == 10:
        return [(pick(PATIENTS) + R.choice((" ", ": ", ", ", " is ")), None), *_person(), (R.choice((", ", " of ", ", ", "; ", ",\n")), None), (address(), 4), (R.choice((".", ", " + pick(PHONE_CUE).lower() + " ", ", ")), None), *([(phone(), 1), (".", None)] if R.random() < 0.6 else [])]
    if x == 0:
        return [(_cap(_who()) + R.choice((" ", ", ", ": ", " is ", ", named ")), None), *_person(), (R.choice((", ", " ", " was there", " ")) + pick(ABOUT) + ".", None)]
    if x == 1:
        return [(R.choice((pick(SUBJECTS) + " was ", "", "Report ", "Case ", "Then ")) + pick(DONE_BY) + " by ", None), *_person(), (_end(), None)]
    if x == 2:
        return [(R.choice((pick(SUBJECTS), "I", "We")) + " " + pick(SPOKE) + R.choice((" ", " ", " " + _who() + " ", " " + _who() + ", ")), None), *_person(), (_end(), None)]
    if x == 3:
        return [*_person(), (" " + pick(NAME_VERB) + _end(), None)]
    if x == 4:
        return [(pick(NAME_FIELD) + R.choice((": ", ":", " ", " - ", ":\n", "  ")), None), *_person(), (R.choice(("", "", ".", "\n", "; ")), None)]
    if x == 5:
        parts = [(R.choice((pick(NAME_FIELD) + ": ", "With ", "Present: ", pick(DONE_BY).capitalize() + " by ", "")), None)]
        for k in range(R.choice((2, 3))):
            parts += [(R.choice(("; ", " and ", " / ", "; ")) if k else "", None), *_person()]
        return [*parts, (R.choice((".", "", "\n")), None)]
    if x == 6:
        return [(R.choice(("Thanks to ", "According to ", "Signed ", "On behalf of ", "Letter to ", "Discussed with ", "Care of ", "Under ", "History from ", "Dear ", "Also present was ", "In the presence of ", "No objection from ")), None), *_person(), (_end(), None)]
    return [("", None), *_person(), (R.choice(DEGREES) + R.choice(("\n", ".", "")), None)]


def cued_parts(kind: str) -> list:
    item = MAKE[kind]()
    k = KINDS.index(kind)
    if kind == "id_number":
        # A label that nothing is known about counts as a person's: better one placeholder too many than a number left in.
        cue = pick(ID_CUE) if R.random() < 0.82 or UNSEEN else syllables(R.choice((1, 2))) + R.choice((" no.", " ID", " number", "", " card", " document", " permit"))
        cue = cue.lower() if R.random() < 0.25 and not cue.isupper() else cue
        x = R.random()
        sep = R.choice((" ", ": ", " # ", " #", ":", ", ", " is ", " = ", " was "))
        if x < 0.45:
            return [(R.choice((pick(SUBJECTS) + " was " + pick(ID_NEAR) + " ", "The " , _cap(pick(ID_NEAR)) + " ", "Her ", "His ", "With ", "Used ")) + cue + sep, None), (item, k), (_end(), None)]
        return [(cue + sep, None), (item, k), (R.choice(("", ".", "\n", "; ", ", ", " " + pick(ABOUT) + ".")), None)]
    if kind == "address":
        cue = pick(HOME_CUE)
        who = R.choice((pick(SUBJECTS) + " ", _cap(_who()) + " ", "")) if cue[0].islower() else ""
        return [(who + cue + R.choice((" ", " ", ": ")), None), (item, k), (_end(), None)]
    cue = pick(PHONE_CUE if kind == "phone" else MAIL_CUE)
    x = R.random()
    if x < 0.55:
        return [(R.choice(("", "", _cap(_who()) + ", ", "Please ")) + cue + R.choice((" ", ": ", ":", " (", " at ", " on ", " - ")), None), (item, k), (_end(), None)]
    if x < 0.8:
        return [(R.choice((pick(SUBJECTS), _cap(_who()))) + " " + pick(SPOKE).split()[0] + " " + R.choice(("on ", "at ", "from ", "via ", "using ", "through ", "gave ", "left ")), None), (item, k), (_end(), None)]
    return [(pick(ABOUT).capitalize() + R.choice((": ", ", ", " - ", " ")), None), (item, k), (R.choice((" ", ", ")) + pick(ABOUT) + ".", None)]


def within(filler: list[str]) -> list:
    """An item amid a sentence of the filler."""
    words = R.choice(filler).split(" ")
    at = R.randint(1, len(words))
    kind = R.choices(KINDS, (5, 2, 2, 2, 2))[0]
    before, after = " ".join(words[:at]), " ".join(words[at:])
    if kind == "name":
        return [(before + R.choice((" ", ", ")) + R.choice(LINKS).lstrip(",(") , None), *_person(), (" " + after, None)]
    cue = {"phone": PHONE_CUE, "email": MAIL_CUE, "id_number": ID_CUE, "address": HOME_CUE}[kind]
    return [(before + R.choice((" (", ", ", " ", ". ")) + pick(cue) + R.choice((" ", ": ")), None), (MAKE[kind](), KINDS.index(kind)), (R.choice((") ", ", ", " ", ". ")) + after, None)]


def carrier(filler: list[str]) -> tuple[str, list[int]]:
    """A sentence with its labels."""
    x = R.random()
    if x < 0.1:  # several kinds in one
        parts = [(R.choice((_cap(_who()) + " ", pick(NAME_FIELD) + ": ", "")), None), *_person()]
        for kind in R.sample(KINDS[1:], R.choice((1, 2, 3))):
            cue = {"phone": PHONE_CUE, "email": MAIL_CUE, "id_number": ID_CUE, "address": HOME_CUE}[kind]
            parts += [(R.choice((", ", "; ", " - ", ", ", "\n", " (")) + (pick(cue).lower() + R.choice((" ", ": ")) if R.random() < 0.6 or kind == "id_number" else ""), None), (MAKE[kind](), KINDS.index(kind))]
        parts.append((R.choice((".", "", ")", "\n")), None))
    elif x < 0.3:
        parts = within(filler)
    else:
        kind = R.choices(KINDS, (38, 12, 10, 22, 18))[0]
        parts = name_parts() if kind == "name" else cued_parts(kind)
    text, labels = "", []
    for part, k in parts:
        if text.endswith(".") and part.startswith("."):
            part = part[1:]
        if not part:
            continue
        text += part
        labels += [0] * len(part) if k is None else [2 * k + 1] + [2 * k + 2] * (len(part) - 1)
    return text, labels


def person_like() -> str:
    return R.choice((place(), syllables(2), last_name(), pick(LAST), f"{syllables(2)}-{syllables(2)}", syllables(3)))


def plain(filler: list[str]) -> str:
    """A sentence without personal data that looks as if it had some."""
    x = R.randrange(11)
    if x in (0, 9):
        both = R.choice(("", "", "", "-" + person_like(), " " + person_like(), "'s", " and " + person_like()))
        return f"{R.choice(('', '', 'The ', 'A ', 'No '))}{person_like()}{both} {R.choice(('', '', 'type ', 'positive ', 'like '))}{pick(STAIN)} {pick(STAIN_TAIL)}."
    if x == 10:
        return f"{R.choice(('The ', '', 'This '))}{pick(THING_NO)} of the {pick(THINGS)} {R.choice(('is', 'was', 'reads', ':', 'remains'))} {shaped(pick(DECOYS + IDS))}{R.choice(('.', '', ' and ' + pick(DECOY_NEAR) + '.'))}"
    if x == 1:
        return f"{pick(AT_PLACE)} {R.choice(('the ', ''))}{person_like()} {R.choice(('', 'General ', 'Memorial ', 'Thoracic ', 'Regional '))}{pick(PLACES)}{R.choice(('', ', floor ' + digits(1), ', room ' + digits(3), ' ' + digits(1)))}."
    if x in (2, 3):
        cue = pick(DECOY_CUE)
        near = R.choice((" " + pick(DECOY_NEAR) + ".", ".", ";", "", ", " + pick(ABOUT) + "."))
        return R.choice(("", "The ", "Compare with ")) + R.choice((cue, cue.lower())) + R.choice((" ", ": ", " # ", " of the ", " ")).replace(" of the ", " " + pick(STAIN) + " ") + shaped(pick(DECOYS)) + near
    if x == 4:
        return f"{pick(MEASURED)} {shaped(R.choice(('#', '##', '#.#', '## x ##', '# x # x #', '##-##', '####', '##/##', '##:##', '##/##/20##', '20##-##-##', '##.##.20##', '#:###')))} {R.choice((pick(UNITS), ''))}{R.choice(('.', '', ', '))}"
    if x == 5:
        words = [R.choice(HEAD) for _ in range(R.choice((1, 2, 2, 3, 4)))]
        text = " ".join(words)
        return (text if R.random() < 0.6 else text.title()) + R.choice((":", "\n", " ", "\n\n", ": "))
    if x == 6:
        text = R.choice(filler)
        return text.upper() if R.random() < 0.5 else text.title() if R.random() < 0.5 else " ".join(w.capitalize() if R.random() < 0.2 else w for w in text.split(" "))
    if x == 7:
        return f"{_cap(_who())} {R.choice((pick(SPOKE), pick(NAME_VERB), 'was ' + pick(DONE_BY)))} {pick(ABOUT)}."
    if R.random() < 0.4:
        words = R.choice(filler).split(" ")
        at = R.randint(1, len(words))
        return " ".join([*words[:at], R.choice(("on", "since", "from", "dated", "until")), f"{R.randint(1, 31)} {pick(MONTHS)} {R.choice(('19', '20'))}{digits(2)}", *words[at:]])
    return R.choice((f"{pick(SUBJECTS)} {pick(SPOKE)} {_who()} in {pick(MONTHS)}.", f"{pick(MONTHS)} {R.randint(1, 31)}, 20{digits(2)}: {R.choice(filler)}", f"Comparison: {place()} series of {pick(MONTHS)}."))


def number(template: str) -> str:
    return re.sub(r"\{d\}", lambda m: digits(1), template)


def runner() -> str:
    x = R.random()
    text = " ".join(R.choice(HEAD) for _ in range(R.choice((2, 3)))) if x < 0.5 else f"{person_like()} {pick(PLACES)} {R.choice(('', '/ ', '- '))}{R.choice(HEAD).title()}"
    text = text + R.choice((" (continued)", " (cont.)", " - CONT.", "")) if R.random() < 0.3 else text
    return text + ("   " + shaped(pick(DECOYS)) if R.random() < 0.2 else "")


def scan(text: str, labels: list[int]) -> tuple[str, list[int]]:
    """Wrapped like a page; labels follow. Page lines inside a span belong to it."""
    width, crlf, mark = R.randint(45, 90), R.random() < 0.2, R.choice("--‐¬\xad")
    out, lab, line = [], [], 0
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    for k, (a, b) in enumerate(words):
        word, own = text[a:b], labels[a:b]
        if R.random() < 0.03 and word.isalpha():
            at = R.randrange(len(word))
            swap = {"e": "c", "i": "1", "a": "o", "o": "0", "l": "|", "n": "ri", "m": "rn", "s": "5", "t": "f", "u": "ii"}.get(word[at])
            if swap:
                word, own = word[:at] + swap + word[at + 1 :], own[:at] + [own[at] if at or own[at] == 0 else own[at]] * len(swap) + own[at + 1 :]
                own = [x + 1 if n and x % 2 == 1 and own[n - 1] == x else x for n, x in enumerate(own)]
        inside = labels[words[k - 1][1]] if k else 0
        if line + len(word) > width and out:
            room = width - line - 1
            if word.isalpha() and len(word) > 5 and 2 < room < len(word) - 2 and R.random() < 0.7:
                out.append(word[:room] + mark)
                lab += own[:room] + [own[room - 1] and (own[room] or 0)]
                word, own, inside = word[room:], own[room:], own[room]
            end = ("\r\n" if crlf else "\n") + (R.choice((" ", "")) if R.random() < 0.05 else "")
            if R.random() < 0.09:
                head = number(R.choice(PAGE)) + "\n" if R.random() < 0.6 else ""
                end += head + runner() + ("   " + number(R.choice(PAGE)) if R.random() < 0.4 else "") + "\n"
                end = end.upper() if R.random() < 0.2 else end
            out.append(end)
            lab += [inside + (inside % 2) if inside else 0] * len(end)
            line = 0
        elif out:
            out.append(" ")
            lab.append(inside)
            line += 1
        out.append(word)
        lab += own
        line += len(word)
    return "".join(out), lab


def sample(filler: list[str]) -> tuple[str, list[int]]:
    text, labels = "", []
    for _ in range(R.randint(4, 9)):
        x = R.random()
        if x < 0.42:
            t, own = carrier(filler)
        else:
            t = plain(filler) if x < 0.68 else R.choice(filler)
            own = [0] * len(t)
        gap = " " if R.random() < 0.85 else R.choice(("\n", "\n\n"))
        text += t + gap
        labels += own + [0] * len(gap)
    return scan(text, labels) if R.random() < 0.65 else (text, labels)


def held_out(filler: list[str], n: int, seed: int = 1) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts of unseen patterns, words and formats, with their items (start, end, kind)."""
    global UNSEEN
    UNSEEN = True
    R.seed(seed)
    try:
        out = []
        for _ in range(n):
            text, labels = "", []
            for _ in range(6):
                t, own = carrier(filler) if R.random() < 0.6 else (plain(filler), None)
                text += t + " "
                labels += (own or [0] * len(t)) + [0]
            begins = [k for k, v in enumerate(labels) if v % 2]
            spans = []
            for k in begins:
                end = k + 1
                while end < len(labels) and labels[end] == labels[k] + 1:
                    end += 1
                spans.append((k, end, KINDS[labels[k] // 2]))
            out.append((text, spans))
        return out
    finally:
        UNSEEN = False


def batch(filler: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.full((size, LENGTH), 95, dtype=np.int16), np.zeros((size, LENGTH), dtype=np.int8)
    for k in range(size):
        text, labels = sample(filler)
        at = R.randint(0, max(0, len(text) - LENGTH))
        ids = encode(text[at : at + LENGTH])
        x[k, : len(ids)] = ids
        y[k, : len(ids)] = labels[at : at + LENGTH]
    return x, y


def allowed() -> np.ndarray:
    """0 for possible steps, a large penalty for a continuation of what did not begin."""
    bad = np.zeros((LABELS, LABELS), dtype=np.float32)
    for to in range(2, LABELS, 2):
        bad[:, to] = -1e4
        bad[to - 1, to] = bad[to, to] = 0
    return bad


def sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def loss_and_grads(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, bad: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    b, t = x.shape
    n = HIDDEN
    table = p["e"] @ p["wx"] + p["b"][:, None]  # (2, CHARS, 4H)
    xs = np.stack([x, x[:, ::-1]])
    h, c = np.zeros((2, b, n), np.float32), np.zeros((2, b, n), np.float32)
    keep, hs = [], np.zeros((2, t, b, n), np.float32)
    for k in range(t):
        g = h @ p["wh"]
        g[0] += table[0][xs[0, :, k]]
        g[1] += table[1][xs[1, :, k]]
        s, v = sig(g[..., : 3 * n]), np.tanh(g[..., 3 * n :])
        i, f, o = s[..., :n], s[..., n : 2 * n], s[..., 2 * n :]
        before = c
        c = f * c + i * v
        tc = np.tanh(c)
        keep.append((h, before, i, f, o, v, tc))
        h = o * tc
        hs[:, k] = h
    back = hs[1, ::-1]
    em = hs[0] @ p["wo"][0] + back @ p["wo"][1] + p["bo"]  # (T, B, L)
    trans = p["trans"] + bad
    ahead = np.zeros_like(em)
    ahead[0] = p["start"] + em[0]
    for k in range(1, t):
        ahead[k] = lse(ahead[k - 1][:, :, None] + trans, 1) + em[k]
    behind = np.zeros_like(em)
    for k in range(t - 2, -1, -1):
        behind[k] = lse(trans + (em[k + 1] + behind[k + 1])[:, None, :], 2)
    z = lse(ahead[-1], 1)
    yt, rows = y.T.astype(np.int64), np.arange(b)
    gold = p["start"][yt[0]] + em[0, rows, yt[0]]
    for k in range(1, t):
        gold = gold + trans[yt[k - 1], yt[k]] + em[k, rows, yt[k]]
    loss = float((z - gold).mean())
    d_em = np.exp(ahead + behind - z[None, :, None])
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grads["start"] += d_em[0].sum(axis=0) / b
    np.add.at(grads["start"], yt[0], -1 / b)
    for k in range(1, t):
        pair = np.exp(ahead[k - 1][:, :, None] + trans + (em[k] + behind[k])[:, None, :] - z[:, None, None])
        grads["trans"] += pair.sum(axis=0) / b
        np.add.at(grads["trans"], (yt[k - 1], yt[k]), -1 / b)
    np.put_along_axis(d_em, yt[:, :, None], np.take_along_axis(d_em, yt[:, :, None], 2) - 1, 2)
    d_em /= b
    grads["bo"] = d_em.sum(axis=(0, 1))
    grads["wo"][0] = np.einsum("tbh,tbl->hl", hs[0], d_em)
    grads["wo"][1] = np.einsum("tbh,tbl->hl", back, d_em)
    d_hs = np.stack([d_em @ p["wo"][0].T, (d_em @ p["wo"][1].T)[::-1]])
    dh, dc = np.zeros((2, b, n), np.float32), np.zeros((2, b, n), np.float32)
    d_table = np.zeros_like(table)
    for k in range(t - 1, -1, -1):
        h0, c0, i, f, o, v, tc = keep[k]
        dh = dh + d_hs[:, k]
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate([dc * v * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - v * v)], axis=2)
        grads["wh"] += np.transpose(h0, (0, 2, 1)) @ dg
        np.add.at(d_table[0], xs[0, :, k], dg[0])
        np.add.at(d_table[1], xs[1, :, k], dg[1])
        dh = dg @ np.transpose(p["wh"], (0, 2, 1))
        dc = dc * f
    grads["b"] = d_table.sum(axis=1)
    grads["wx"] = p["e"].T @ d_table
    grads["e"] = (d_table @ np.transpose(p["wx"], (0, 2, 1))).sum(axis=0)
    return loss, grads


def _work(pipe, filler: list[str], seed: int) -> None:
    R.seed(seed)
    bad = allowed()
    while (p := pipe.recv()) is not None:
        pipe.send(loss_and_grads(p, *batch(filler, BATCH), bad))


def train(filler: list[str], steps: int, rate: float = 6e-3, out: str | None = None, processes: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(3)
    make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
    p = {
        "e": rng.standard_normal((CHARS, EMBED)).astype(np.float32) * 0.3, "wx": make(2, EMBED, 4 * HIDDEN), "wh": make(2, HIDDEN, 4 * HIDDEN), "b": np.zeros((2, 4 * HIDDEN), np.float32),
        "wo": make(2, HIDDEN, LABELS), "bo": np.zeros(LABELS, np.float32), "trans": np.zeros((LABELS, LABELS), np.float32), "start": np.zeros(LABELS, np.float32),
    }
    p["b"][:, HIDDEN : 2 * HIDDEN] = 1.0
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    mean = {k: x.copy() for k, x in p.items()}
    pipes, workers = [], []
    for k in range(processes):
        own, other = multiprocessing.Pipe()
        workers.append(multiprocessing.Process(target=_work, args=(other, filler, 100 + k), daemon=True))
        workers[-1].start()
        pipes.append(own)
    for step in range(1, steps + 1):
        for pipe in pipes:
            pipe.send(p)
        got = [pipe.recv() for pipe in pipes]
        loss = sum(x for x, _ in got) / processes
        grads = {k: sum(g[k] for _, g in got) / processes for k in p}
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        now = rate * min(1.0, step / 50) * (0.5 * (1 + np.cos(np.pi * step / steps)) + 0.02)
        for k in p:
            g = grads[k] * scale
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            mean[k] += (p[k] - mean[k]) * 0.02
        if step % 50 == 0:
            print(step, round(loss, 4), flush=True)
        if out and step % 200 == 0:
            save(mean, out)
    for pipe in pipes:
        pipe.send(None)
    return mean


def save(p: dict[str, np.ndarray], out: str) -> None:
    table = p["e"] @ p["wx"] + p["b"][:, None]
    np.savez_compressed(out, table=table.astype(np.float16), wh=p["wh"].astype(np.float16), wo=p["wo"].astype(np.float16), bo=p["bo"], trans=p["trans"] + allowed(), start=p["start"])


def filler_of(path: str) -> list[str]:
    import pyarrow.parquet as pq

    rows = pq.read_table(path, columns=["text", "lang"]).slice(0, MAX_FILLER).to_pylist()
    return [s for r in rows if r["text"] and r["lang"] == "en" for s in re.split(r"(?<=[.])\s+", r["text"]) if 20 < len(s) < 260]


def main() -> None:
    steps, processes = (int(x) for x in (sys.argv[3:] + ["1500", "8"][len(sys.argv) - 3 :]))
    save(train(filler_of(sys.argv[1]), steps, out=sys.argv[2], processes=processes), sys.argv[2])


if __name__ == "__main__":
    main()
