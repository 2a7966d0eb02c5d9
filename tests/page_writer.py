"""Form pages written for tests in the two captured layouts and the three fallback ones."""

RUN_LABELS = ("finish", "margin", "mrk", "split", "settle")


def runner(tab, name, form, market, profile, best, records, dls, box, last, scratched=False, listed=None):
    return dict(
        tab=tab, name=name, form=form, market=market, profile=profile, best=best, records=records, dls=dls, box=box,
        last=last, scratched=scratched, listed=listed,
    )


# Expected values of two captured fields: form, market line, trainer win/place, best time,
# career/course/distance/both records, days since last run, wins and starts from the box, last run.
FIELD_A = [
    runner(1, "FADE OUT", "41544", "betfair$22", (14, 36), "23.31", ("17%-17%-6", "0%-0%-2", "17%-17%-6", "0%-0%-2"), 7, (1, 0, 0), (4, 7, 5.1, .80, 8.68, 4), listed="15"),
    runner(2, "SONIA'S SHARK", "85676", "Tab$4.2", (34, 60), None, None, None, (3, 0, 5), None, scratched=True),
    runner(3, "RAPID WATERBOY", "17658", "betfair$400", (12, 30), "23.20", ("2%-21%-42", "4%-25%-24", "2%-20%-41", "4%-25%-24"), 8, (3, 0, 1), (8, 8, 12.5, .86, 9.05, 8), listed="61"),
    runner(4, "SCARY STORM", "42743", "betfair$1.62", (18, 56), "22.88", ("11%-44%-9", "0%-100%-1", "0%-100%-1", "0%-100%-1"), 31, (4, 0, 1), (3, 8, 14.0, 1.08, 5.29, 8), listed="1.5"),
    runner(5, "SPEEDY JUDE", "3466x", "betfair$6.6", (10, 38), "22.93", ("12%-50%-8", "0%-100%-1", "0%-100%-1", "0%-100%-1"), 279, (5, 0, 0), (6, 6, 14.2, 1.11, 5.36, 5), listed="4.4"),
    runner(6, "TRACKMAN TIM", "35442", "betfair$5.5", (16, 40), "23.01", ("8%-42%-12", "0%-40%-5", "10%-40%-10", "0%-50%-4"), 4, (6, 0, 2), (2, 8, 4.3, .29, 4.03, 4), listed="4.4"),
    runner(7, "SASSY BELLE", "52x57", "betfair$95", (4, 30), "23.04", ("10%-30%-10", "20%-40%-5", "14%-43%-7", "33%-67%-3"), 18, (7, 0, 0), (7, 4, 12.9, 1.30, 6.76, 5), listed="71"),
    runner(8, "PATS FOR ARTHUR", "86717", "Tab$9", (12, 30), "23.59", None, None, (1, 0, 2), None, scratched=True),
    runner(9, "SNOOPY", "78746", "betfair$150", (4, 14), "22.92", ("5%-26%-19", "5%-26%-19", "5%-26%-19", "5%-26%-19"), 7, (2, 1, 3), (6, 7, 8.4, 1.03, 8.74, 6), listed="61"),
]
FIELD_B = [
    runner(1, "NANGAR ZARA", "41215", "betfair$1.53", (28, 54), "30.39", ("9-5-26", "3-2-9", "2-2-11", "2-1-4"), 9, (1, 2, 4), (5, 8, 10.5, .75, 9.60, 3), listed="1.5"),
    runner(2, "LAUNCH MODE", "22428", "betfair$15.5", (14, 54), None, ("6-8-32", "0-1-2", "3-4-20", "0-0-0"), 23, (2, 1, 5), (8, 8, 9.0, .65, 5.27, 6), listed="9.5"),
    runner(3, "HOOKED ON DOLLY", "23148", "betfair$50", (16, 50), None, ("3-9-21", "2-3-8", "1-3-7", "0-0-0"), 9, (3, 1, 2), (8, 8, 8.8, 1.20, 9.82, 6), listed="23"),
    runner(4, "SCOTCH ROCKET", "23113", "betfair$42", (24, 48), "31.08", ("9-16-42", "0-0-1", "7-8-24", "0-0-1"), 6, (4, 1, 8), (3, 7, 6.5, .54, 9.46, 6), listed="26"),
    runner(5, "SPRING FOCUS", "53542", "betfair$180", (14, 42), "30.84", ("2-14-40", "1-6-23", "0-5-13", "0-2-5"), 7, (5, 0, 5), (2, 7, 4.8, .34, 9.25, 4), listed="51"),
    runner(6, "ALLEY ACRES", "81587", "Tab$7", (14, 40), None, None, None, (6, 1, 4), None, scratched=True),
    runner(7, "TRUE HORNET", "24564", "betfair$18.5", (16, 42), None, ("2-2-10", "0-1-2", "2-1-6", "0-0-0"), 6, (7, 1, 1), (4, 8, 3.3, .23, None, 5), listed="14"),
    runner(8, "BLOW BAYOU", "51261", "betfair$3.9", (18, 56), "30.52", ("8-7-23", "4-5-15", "1-0-2", "1-0-1"), 7, (8, 1, 4), (1, 7, 4.8, .0, 9.06, 2), listed="3.3"),
]


def run(finish, field, margin, mrk, split, settle, note="", extra=""):
    first = f" 1st Split {split}" if split is not None else ""
    return [
        f"{finish} of {field}", "7d", "MRK", f"3rd {mrk:+.2f}",
        f"18 Aug 2026 (7d ago) Q PARK (AUSTRALIA): Margin {margin}L Distance 520m Surface AW SOT G Class GR 5 Prize AUD $1 "
        f"Race Time 0:30.02 BOM 29.52sec BOM Time Adj +0.5sec Runner Time 30.10{first} R.WT 30.1kg BP 4 SP $4.60 "
        f"{'Stewards ' + note + ' ' if note else ''}Inrunning Position {settle}th Place on settling{extra} "
        "Runner Sectional 5.3sec Race/Horse Sectionals: L1m (5.31 6th)",
        "| Your Comment: Comment",
    ]


def block(r, short=False):
    lines = ["", r["form"], r["market"], f"{r['name']}  2yo DK BDL B", "TrainerSOME ONE", f"Tra L50{r['profile'][0]}%-{r['profile'][1]}%-50"]
    lines += ["Tra/Dist Best Time-"] if r["best"] is None else ["Tra/Dist Best Time", r["best"]]
    box, wins, starts = r["box"]
    cells = lambda v: "\t".join(str(v if b == box else 0) for b in range(1, 9))
    lines += ["", "Box Stats\t1\t2\t3\t4\t5\t6\t7\t8", f"Win\t{cells(wins)}", f"2nd/3rd\t{cells(0)}", f"Starts\t{cells(starts)}"]
    if r["records"] is None:
        return lines
    car, crs, dist, both = r["records"]
    lines += ["FiltersWPS WPS(%)", "Car", f"{car}12m", f"{car}Crs", f"{crs}Dist", f"{dist}Crs & Dist", f"{both}FU", "0-0-02U", "1-0-13U", "0-0-1ClockW",
              "0-0-0AClockW", "0-0-0Dirt", "0-0-0Sand", "0-0-0", "Facts", "Car PM", "$1.2k12m PM", "$196DLS", "3DLW", "20(3)ROI", "23.33%For-Against"]
    lines += [f"Days Since Last Run: {r['dls']} days (6U)"]
    lines += run(*r["last"])
    lines += ["18 Aug 2026 Q PARK : Margin 99L Distance 400m SOT Trial Time 0:00.00 Runner Time none"]
    lines += run(1, 8, 2.0, -0.1, 5.0, 2, "Slow to begin; Checked.", " 5th Place on turn")
    return lines


def table(field, layout):
    rows = []
    for r in field:
        price = "Scr" if r["scratched"] else r["listed"]
        spare = "Scr" if r["scratched"] else ""
        tab, name = r["tab"], r["name"]
        rows.append({
            "weight": f"{tab}\t{name}\t27.5\tSOME ONE\t{spare}\t{price}",
            "money": f"{tab}\t{name}\t$45.5k\t$1.8k\tSOME ONE\t$64.3k\t$790.4k\t{spare}\t{price}",
            "pipe": f"| {tab} | [**{name}**](https://example.org/x) | 27.5 | [SOME ONE](https://example.org/y) | {spare} | {price} |",
            "anchor": f"{tab}   {name}   27.5   SOME ONE   {price}",
            "cells": f"{tab}\n{name}\n27.5\nSOME ONE\n" + ("Scr" if r["scratched"] else f"${price}"),
        }[layout])
    head = {
        "weight": "Tab\tRunner\tWT\tTrainer\t\t", "money": "Tab\tRunner\tTot $PM\tCar$/St\tTrainer\tTra L50\tTra PM\tBet\tTab",
        "pipe": "| Tab | Runner | WT | Trainer | | |", "anchor": "Field", "cells": "Tab\nRunner\nWT\nTrainer",
    }[layout]
    return [head, *rows, "Explanations "]


def page(field, layout, with_blocks=True):
    lines = ["Form", "Racing", " \xa0", "Q Lakeside Form Guide (Race 9) | Enhanced Form", "Tuesday, 25th August 2026", "Race 1", "", "9", "17:55", "(local)",
             "SOME CUP", "Type: 5th Grade Fastest Time: 0:30.18 Validate 06 Dec 2025", " AUD $7,000", "550m ALL WEATHER GOOD"]
    lines += table(field, layout)
    for r in field if with_blocks else []:
        lines += block(r)
    return "\n".join(lines)
