"""Words of the trade as tables of terms and labels, and rules over the labels found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Cities by the state that they are taken for.
CITIES = {
    "Karnataka": "bengaluru, bangalore, mysuru, mysore, hubballi, hubli, mangaluru, belagavi",
    "Maharashtra": "mumbai, pune, nagpur, nashik, thane, navi, aurangabad, kolhapur",
    "Tamil Nadu": "chennai, coimbatore, madurai, trichy, tiruchirappalli, salem, tirunelveli",
    "Telangana": "hyderabad, warangal, secunderabad",
    "Andhra Pradesh": "visakhapatnam, vijayawada, guntur, tirupati, nellore, kurnool",
    "Delhi": "delhi, new delhi",
    "Uttar Pradesh": "noida, greater noida, ghaziabad, lucknow, kanpur, varanasi, agra, meerut",
    "Haryana": "gurugram, gurgaon, faridabad, sonipat, panipat, karnal, rohtak, hisar",
    "West Bengal": "kolkata, howrah, durgapur, siliguri, asansol",
    "Gujarat": "ahmedabad, surat, vadodara, rajkot, gandhinagar",
    "Rajasthan": "jaipur, jodhpur, udaipur, kota, ajmer, bikaner",
    "Madhya Pradesh": "bhopal, indore, jabalpur, gwalior, ujjain",
    "Chhattisgarh": "raipur, bhilai, bilaspur",
    "Bihar": "patna, gaya",
    "Jharkhand": "ranchi, dhanbad, jamshedpur",
    "Odisha": "rourkela, bhubaneswar, bhubaneshwar, cuttack",
    "Kerala": "kochi, ernakulam, kozhikode, calicut, thiruvananthapuram, thrissur",
    "Chandigarh": "chandigarh",
    "Punjab": "mohali, ludhiana, amritsar, jalandhar",
    "Uttarakhand": "dehradun, haridwar",
    "Himachal Pradesh": "shimla",
    "Assam": "guwahati, silchar",
}

# States and territories.
STATES = (
    "andhra pradesh, arunachal pradesh, assam, bihar, chhattisgarh, goa, gujarat, haryana, himachal pradesh, jharkhand, karnataka, kerala, madhya pradesh, "
    "maharashtra, manipur, meghalaya, mizoram, nagaland, odisha, punjab, rajasthan, sikkim, tamil nadu, telangana, tripura, uttar pradesh, uttarakhand, "
    "west bengal, delhi, jammu and kashmir, ladakh, puducherry, chandigarh"
)

# Skills.
SKILLS = (
    "autocad, auto cad, civil 3d, staad pro, staad, etabs, safe, revit, tekla, navisworks, primavera, ms project, microsoft project, planswift, ms excel, excel, "
    "bim, gis, qgis, arcgis, total station, dumpy level, autolevel, auto level, boq, estimation, billing, rate analysis, bar bending schedule, bbs, "
    "quantity surveying, quantity surveyor, site supervision, site execution, surveying, drafting, tendering, contracts, hse, safety, quality control, "
    "quality assurance, qa/qc, qa/qc civil, project management, planning, scheduling, structural design, rcc, steel structures, water supply, sewerage, roads, "
    "highways, bridges, irrigation, metro, tunnelling, geotechnical, soil investigation, foundation, earthwork, pavement, asphalt, construction management, "
    "site engineer tools, pdf, sketchup, 3ds max"
)

# What marks a private employer, and a public one.
PRIVATE = "private limited, pvt ltd, pvt. ltd, llp, manpower, staffing, consultancy, solutions private, lifecare, walk-in, walkin"
PUBLIC = (
    "government, govt, psu, public sector, gov.in, nic.in, ministry of, department of, pwd, public works, nhai, cpwd, railway, metro rail, smart city, jal nigam, "
    "nigam, development authority, public service commission, examination authority, recruitment board, ssc je, rrb je, state psc, upsc, engineering services"
)

# Kinds of employment and ways of work, the first one that a text names counts.
JOB_TYPES = {
    "Full-time": "full time, full-time, fulltime", "Part-time": "part time, part-time, parttime", "Contract": "contract, contractual", "Internship": "intern, internship",
    "Temporary": "temporary, temp", "Freelance": "freelance",
}
WORK_MODES = {"Remote": "work from home, workfromhome, wfh, remote", "Hybrid": "hybrid", "On-site": "onsite, on site, on-site, site based, site-based"}


def terms(spark: SparkSession, words: dict[str, str]) -> DataFrame:
    """term, label of comma-separated terms by label."""
    return spark.createDataFrame([(t.strip(), label) for label, said in words.items() for t in said.split(",")], "term string, label string")


def first_label(spark: SparkSession, words: dict[str, str]) -> DataFrame:
    """Rules by which the first of the labels that a text has is its verdict."""
    return spark.createDataFrame([(i, [label], [], label) for i, label in enumerate(words)], "rank int, needs array<string>, bars array<string>, verdict string")


def sector_rules(spark: SparkSession) -> DataFrame:
    """A private mark outweighs all public ones."""
    return spark.createDataFrame([(0, ["public"], ["private"], "Government")], "rank int, needs array<string>, bars array<string>, verdict string")
