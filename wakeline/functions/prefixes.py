"""Flags of identifier prefixes (the first three digits), and prefixes that no ship should have."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

# Prefix and flag. Where the list in use differs from the public allocation (457, 572, 654, 660, 671, 677 and
# a few others), the list in use is followed, so that results stay the same.
FLAGS = """
204 PT 205 BE 208 BE 209 CY 210 CY 211 DE 212 CY 215 MT 218 DE 219 DK 220 DK 221 ES 224 ES 225 ES 226 FR 227 FR 228 FR 229 MT 230 FI 232 GB 233 GB 234 GB 235 GB 236 GI 238 HR 239 GR
240 GR 241 GR 244 NL 245 NL 246 NL 247 IT 248 MT 249 MT 250 IE 251 IS 253 LU 255 PT 256 MT 257 NO 258 NO 259 NO 261 PL 263 PT 264 RO 265 SE 266 SE 269 CH 271 TR 272 TR 273 RU 274 RU
275 LV 276 EE 277 LT 303 US 305 AG 306 VG 308 BS 309 BS 311 BS 312 BZ 314 BB 316 CA 319 KY 325 GD 329 KN 330 LC 334 HN 338 US 341 MX 345 NI 346 PA 350 PA 351 PA 352 PA 353 PA 354 PA
355 PA 356 PA 357 PA 359 JM 362 TT 366 US 367 US 368 US 369 US 370 PA 371 PA 372 PA 373 PA 378 DO 379 PR 401 IQ 403 SA 405 BD 407 SY 408 BH 412 CN 413 CN 414 CN 416 IN 417 LK 419 IN
422 IR 431 JP 432 JP 434 IR 440 KR 441 KR 447 KW 450 IL 455 JO 457 MN 461 RU 462 RU 466 QA 468 OM 470 AE 477 HK 502 MV 503 AU 506 MM 508 NP 511 PW 512 NZ 514 KH 515 KH 516 BN 518 CK
520 PN 521 TO 522 WS 523 FJ 525 ID 529 TK 533 MY 538 MH 540 NC 546 PF 548 PH 550 VU 553 TV 555 WF 559 WS 563 SG 564 SG 565 SG 566 SG 567 TH 570 SB 572 TW 574 VN 576 VU 578 VN 601 ZA
609 BJ 610 BW 611 BF 612 CF 613 CM 615 MR 616 ML 618 GW 619 CI 620 KM 621 DJ 622 EG 625 ER 626 GA 627 GH 629 GM 631 GQ 632 GN 633 GW 636 LR 637 LR 641 ZZ 645 MU 648 SD 649 SO 654 SC
655 LY 657 NG 659 NA 660 ET 663 SN 664 TZ 665 UG 666 MZ 667 SL 668 ST 669 KE 670 ZA 671 ZM 672 ZW 674 TZ 677 DZ 678 MA 681 TN 687 CV 710 BR
"""
HIGH_RISK = "BB CK CM GA GM GN GQ HN KM PW RU SL ST TV TZ VU"
LOW_RISK = "AU BE CA DE DK ES FI FR GB IE IT JP KR NL NO NZ PT SE US"
# Prefixes that have been given out, as first and last.
ALLOCATED = """
201-216 218-220 224-259 261 263-279 301 303-312 314 316 319 321 323 325 327 329-332 334 336 338-339 341 343 345 347-348 350-359 361-362 364 366-379 401 403 405 408 410 412-414 416-417 419
422-423 425 428 431-432 434 436-438 440-441 443 445 447 450-451 453 455-457 459 461 463 466 468 470-473 475 477-478 501 503 506 508 510-512 514-516 518 520 523 525 529 531 533 536 538 540
542 544 546 548 550 553 555 557 559 561 563-567 570 572 574 576-578 601 603 605 607-613 615-622 624-627 629-638 642 644-645 647 649-650 654-657 659-672 674-679 701 710 720 725 730 735 740 745
750 755 760 765 770 775
"""
LANDLOCKED = "203 243 252 253 267 268 269 270 401 410 434 436 437 451 457 459 472 531 609 611 612 624 633 638 644 649 655 656 661 669 670 675 679 720 755"
TINY = "607 608 618 635 660 665"


def numbers(text: str) -> set[int]:
    """The numbers of a list of numbers and first-last ranges."""
    out: set[int] = set()
    for part in text.split():
        low, _, high = part.partition("-")
        out |= set(range(int(low), int(high or low) + 1))
    return out


FLAG_OF = dict(zip(map(int, FLAGS.split()[::2]), FLAGS.split()[1::2]))


def flag_of(prefix: Column) -> Column:
    """Flag of a prefix (a number); null where no flag is known."""
    return F.create_map(*(F.lit(x) for pair in FLAG_OF.items() for x in pair))[prefix.cast("int")]


def flag_risk(flag: Column) -> Column:
    """high, low, medium, or unknown without a flag."""
    f = F.upper(flag)
    return F.when(flag.isNull() | (flag == ""), "unknown").when(f.isin(HIGH_RISK.split()), "high").when(f.isin(LOW_RISK.split()), "low").otherwise("medium")


def prefix_kind(prefix: Column) -> Column:
    """unallocated, landlocked, tiny, or null for a prefix that says nothing; the first that holds."""
    p = prefix.cast("int")
    return F.when(~p.isin(sorted(numbers(ALLOCATED))), "unallocated").when(p.isin(sorted(numbers(LANDLOCKED))), "landlocked").when(p.isin(sorted(numbers(TINY))), "tiny")
