"""Row types of the exam domain, declared once; JSON is parsed with these, never inferred."""

from __future__ import annotations

OPTION = "struct<label:string,text:string>"
QUESTION = (
    f"struct<id:string,question_number:string,stem:string,options:array<{OPTION}>,correct_answer:string,"
    "explanation:string,stimulus_id:string,stimulus_text:string,section:string>"
)
RESULT = (
    f"struct<question_id:string,question_number:string,stem:string,options:array<{OPTION}>,student_answer:string,"
    "correct_answer:string,is_correct:boolean,explanation:string,stimulus_text:string>"
)
EXAMS = f"id string, title string, subject string, grade string, duration_minutes int, created_at string, questions array<{QUESTION}>"
REQUESTS = "exam_id string, student_name string, student_code string, answers map<string,string>"
SUBMISSIONS = (
    "id string, exam_id string, exam_title string, student_name string, student_code string, submitted_at string, "
    f"total_questions int, correct_count int, score double, percentage double, detailed_results array<{RESULT}>"
)
SPANS = "doc_id string, close_order int, start int, end int, label string, text string, params map<string,string>"
TASKS = (
    "id string, status string, progress int, message string, filename string, add_to_bank boolean, title string, "
    "subject string, grade string, duration_minutes int, created_at string, completed_at string, error string, added_to_bank_id string"
)
TASK_EVENTS = "task_id string, seq int, ts timestamp_ntz, progress int, message string, status string, error string"
PROGRESS_EVENTS = "type string, step int, step_name string, progress int, message string, streamed_tokens int, estimated_tokens int"

DEFAULT_DURATION = 45
DEFAULT_STUDENT_CODE = "STU001"
#: Base tags of the annotation language and the label ids made from them (fixed values, in this order).
BASE_TAGS = ("question", "question_label", "stem", "option_label", "option_text", "stimulus", "section", "explanation")
