"""Texts of messages and reasons."""

# Messages that users of the reports read and compare, word for word.
TEXTS = {
    # Completeness and arrangement
    "one_view_missing": "Bitta asosiy proyeksiya yetishmaydi",
    "two_views_missing": "Kamida ikkita asosiy proyeksiya yetishmaydi",
    "no_views": "Asosiy proyeksiyalar topilmadi",
    "no_isometric": "Yaqqol tasvir topilmadi",
    "no_front": "FRONT view aniqlanmadi",
    "no_top": "TOP view aniqlanmadi",
    "no_side": "SIDE view aniqlanmadi",
    "arrangement_needs_front": "Arrangement tekshirish uchun FRONT yo‘q",
    "top_wrong_side": "TOP view FRONT'ga nisbatan noto‘g‘ri tomonda",
    "top_not_aligned": "TOP view FRONT bilan vertikal o‘qda yetarli mos emas",
    "top_not_checked": "TOP view yo‘qligi sabab arrangement tekshirilmadi",
    "side_wrong_side": "SIDE view FRONT'ga nisbatan chap/o‘ngda joylashmagan",
    "side_not_aligned": "SIDE view FRONT bilan gorizontal o‘qda yetarli mos emas",
    "side_not_checked": "SIDE view yo‘qligi sabab arrangement tekshirilmadi",
    "extra_views": " ta ortiqcha orthographic region mavjud yoki roli aniqlanmagan",
    # Hatching
    "no_hatch": "Hatch/qirqim topilmadi. Keyin task compliance moduli qirqim talab qilingan-qilinmaganini tekshiradi.",
    "hatch_angle": "Hatch chiziqlari burchagi yetarli darajada bir xil emas",
    "hatch_spacing": "Hatch chiziqlari oralig‘i notekis",
    "hatch_parallel": "Hatch diagonallari yetarli darajada parallel emas",
    "hatch_spacing_unknown": "Hatch spacing regularity to‘liq baholanmadi",
    "hatch_coverage": "Hatch coverage juda kichik yoki juda katta ko‘rinadi",
    # Dimensions
    "no_dimensions": "Asosiy ko‘rinishlar atrofida o‘lcham evidence topilmadi",
    "dimensions_one_view": "O‘lchamlar faqat bitta ko‘rinishda aniq ko‘rindi",
    "dimension_text_low": "O‘lcham matni/raqamlariga oid evidence juda kam",
    "dimension_lines_low": "Dimension line evidence juda kam",
    # Line semantics
    "no_contours": "Asosiy kontur chiziqlari evidence topilmadi",
    "contours_one_view": "Kontur chiziqlari faqat bitta ko‘rinishda aniq ko‘rindi",
    "hidden_low": "Shtrix/yashirin chiziqlar evidence juda kam",
    "center_low": "Markaz chiziqlari evidence topilmadi yoki juda sust",
    "center_weak": "Markaz chiziqlari kuchsiz evidence bilan topildi",
    # Cleanliness
    "blurred": "Rasmning aniqligi past yoki biroz xira ko‘rinadi",
    "contrast_low": "Kontrast past, chiziqlar ajralishi sust bo‘lishi mumkin",
    "stray_marks": "Asosiy zonalardan tashqarida ortiqcha shovqin/kir belgilari mavjud",
    "tight_edge": "Chizma chetga juda yaqin yoki crop juda tig‘iz",
    # Task compliance
    "views_short": "Talab qilingan proyeksiyalar soni yetarli emas: kerak=",
    "views_found": ", topildi=",
    "isometric_required": "Topshiriqda yaqqol tasvir talab qilingan, lekin topilmadi",
    "section_required": "Topshiriqda qirqim/kesim talab qilingan, lekin evidence topilmadi",
    "dimensions_required": "Topshiriqda o‘lcham qo‘yish talab qilingan, lekin dimension evidence topilmadi",
    "dimensions_once": "O‘lcham evidence bor, lekin faqat bitta ko‘rinishda aniq topildi",
    # Feedback
    "fb_completeness": "Proyeksiyalar soni yoki joylashuvi bo‘yicha kamchiliklar bor.",
    "fb_hatching": "Qirqim/shtrixlash sifati yoki aniqlanishida muammo bor.",
    "fb_dimensions": "O‘lcham qo‘yish evidence sust yoki to‘liq emas.",
    "fb_lines": "Chiziq turlari evidence yetarli emas.",
    "fb_cleanliness": "Chizma sifati, tozaligi yoki crop holati yaxshilanishi kerak.",
    "fb_compliance": "Topshiriq talablariga to‘liq moslik kuzatilmadi.",
    "fb_all_good": "Chizma topshiriq va GOST/ESKD mezonlariga yaxshi mos keldi.",
    # Layout confidence
    "few_projections": "Projection count juda kam topildi; layout ishonchliligi past bo‘lishi mumkin.",
    "many_projections": "Projection count juda ko‘p topildi; ortiqcha box yoki merge xatosi bo‘lishi mumkin.",
    "no_orthographic": "Orthographic role ajratilmadi.",
    "many_orthographic": "Orthographic role soni odatdagidan ko‘p.",
    "isometric_unseen": "Yaqqol tasvir aniqlanmadi.",
    "no_title_block": "Title block topilmadi.",
    "one_large_box": "Bitta projection box juda katta; bir nechta ko‘rinish merge bo‘lgan bo‘lishi mumkin.",
    # Reasons for a zero
    "view_area_small": "student_visible_area_too_small",
    "view_not_drawn": "student_did_not_draw_visible_view",
    "view_area_ratio": "visible_view_area_ratio_too_small",
    "view_no_diagonals": "student_has_no_visible_view_diagonal_structure",
    "section_no_reference": "reference_section_region_not_found_or_invalid_roi",
    "section_missing": "student_has_no_section_region",
    "section_misplaced": "student_section_not_in_correct_place",
}
